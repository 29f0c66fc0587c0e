"""Word n-gram Jaccard join: components of documents whose shingle sets are alike, by prefix trees.

Documents with equal sets become one node. A node can only link if percent of its shingles occur in another node, so a first
exchange of shortened hashes finds how many of each node's shingles are shared; in ordinary text that leaves the near copies. Among
those, shingles are put in one global order, rarest first, and nodes that share an element of their prefixes (the part in which
linked sets must meet) are joined to candidate groups. Each group is worked off by :mod:`set_trie`.

No step drops a link: shortened hashes can only make a shingle look shared, prefixes hold the first common element of any linked
pair, and groups are unions of all nodes that meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.components import components
from sieveline.llm.set_trie import jaccard_components
from sieveline.llm.tables import documents_of, kept, parts_for
from sieveline.llm.words import mix, run_hashes, word_chunks

PERCENT, N_WORDS = 75, 5
PER_BUCKET, PER_GROUP = 1_000_000, 4_000_000


def shingle_sets(texts: pa.Array, n: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text: a text of fewer than n words is one shingle, one without words has none."""
    for first, end, words in word_chunks(texts, lower=True):
        at, hashes = words.windows(n)
        cuts, sizes = np.searchsorted(at, words.bounds), np.diff(words.bounds)
        whole = run_hashes(words.hashes, words.bounds[:-1], words.bounds[1:])
        for i in range(end - first):
            yield np.unique(hashes[cuts[i] : cuts[i + 1]]) if sizes[i] >= n else whole[i : i + 1] if sizes[i] else hashes[:0]


def node_of(shingles: np.ndarray) -> int:
    """The set's own 64-bit hash; equal sets have equal ones. As a signed long."""
    return int(np.add.reduce(mix(shingles ^ np.uint64(0x5851F42D4C957F2D))).astype(np.int64))


def _binary(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def _dealt(node_sets, buckets: int, width) -> Iterator[pa.RecordBatch]:
    """Shingles of many nodes as one row for each bucket: nodes, how many shingles each has here, and the shingles."""
    nodes, sets, held, seen = [], [], 0, set()

    def flush():
        sizes = np.array([len(s) for s in sets])
        hashes, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        place = (hashes >> np.uint64(32)) % np.uint64(buckets)
        order = np.argsort(place.astype(np.int32), kind="stable")
        cuts = np.searchsorted(place[order], np.arange(buckets + 1, dtype=np.uint64))
        rows = []
        for b in np.flatnonzero(np.diff(cuts)):
            mine = order[cuts[b] : cuts[b + 1]]
            first = np.flatnonzero(np.diff(owner[mine], prepend=-1))
            counts = np.diff(first, append=len(mine)).astype(np.int32)
            rows.append((int(b), _binary(np.array(nodes)[owner[mine[first]]]), _binary(counts), _binary(hashes[mine].astype(width))))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["bucket", "nodes", "counts", "hashes"]
        )

    for node, shingles in node_sets:
        if node in seen or not len(shingles):
            continue
        seen.add(node)
        nodes.append(node), sets.append(shingles)
        held += len(shingles)
        if held >= 500_000:
            yield flush()
            nodes, sets, held, seen = [], [], 0, set()
    if sets:
        yield flush()


_DEALT = "bucket int, nodes binary, counts binary, hashes binary"


def _gathered(group: pa.Table, width) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Nodes (each once) of a bucket, where each one's hashes begin, the hashes, and the node index of each."""
    nodes, counts, hashes = (
        np.frombuffer(b"".join(group.column(c).to_pylist()), t) for c, t in (("nodes", np.int64), ("counts", np.int32), ("hashes", width))
    )
    first = np.zeros(len(nodes), bool)
    first[np.unique(nodes, return_index=True)[1]] = True
    hashes, nodes, counts = hashes[np.repeat(first, counts)], nodes[first], counts[first]
    return nodes, np.concatenate([[0], np.cumsum(counts)]), hashes, np.repeat(np.arange(len(nodes)), counts)


def _shared_of_bucket(bins: int):
    """How many of each node's shingles here occur in another node, as one row for each bin of nodes."""

    def count(group: pa.Table) -> pa.Table:
        nodes, _, hashes, owner = _gathered(group, np.uint32)
        keys = np.sort((hashes.astype(np.uint64) << np.uint64(32)) | owner.astype(np.uint64))
        same = (keys[1:] >> np.uint64(32)) == (keys[:-1] >> np.uint64(32))
        shared = np.append(same, False) | np.insert(same, 0, False)
        counts = np.bincount((keys[shared] & np.uint64(0xFFFFFFFF)).astype(np.int64), minlength=len(nodes)).astype(np.int32)
        nodes, counts = nodes[counts > 0], counts[counts > 0]
        place = mix(nodes.astype(np.uint64)) % np.uint64(bins)
        order = np.argsort(place, kind="stable")
        used, cuts = np.unique(place[order], return_index=True)
        parts = np.split(order, cuts[1:])[: len(used)]
        return pa.table({
            "bin": pa.array(used.astype(np.int32)),
            "nodes": pa.array([_binary(nodes[p]) for p in parts], pa.binary()),
            "counts": pa.array([_binary(counts[p]) for p in parts], pa.binary()),
        })

    return count


def _shared_of_bin(group: pa.Table) -> pa.Table:
    nodes, counts = (np.frombuffer(b"".join(group.column(c).to_pylist()), t) for c, t in (("nodes", np.int64), ("counts", np.int32)))
    values, at = np.unique(nodes, return_inverse=True)
    return pa.table({"node": values, "shared": np.bincount(at, counts).astype(np.int64)})


def _frequencies_of_bucket(group: pa.Table) -> pa.Table:
    nodes, cuts, hashes, _ = _gathered(group, np.uint64)
    _, at, counts = np.unique(hashes, return_inverse=True, return_counts=True)
    found = counts[at].astype(np.uint32)
    return pa.table({
        "node": nodes,
        "hashes": pa.array([_binary(hashes[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
        "found": pa.array([_binary(found[a:b]) for a, b in zip(cuts[:-1], cuts[1:])], pa.binary()),
    })


def _set_rows(n: int, whole: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(shingle_sets(batch.column("text"), n))
            out = {
                "node": pa.array([node_of(s) if len(s) else None for s in sets], pa.int64()),
                "n": pa.array([len(s) for s in sets], pa.int64()),
            }
            if whole:
                out["hashes"] = pa.array([_binary(s) for s in sets], pa.binary())
            else:
                out["doc_id"] = batch.column("doc_id")
            yield pa.RecordBatch.from_pydict(out)

    return rows


def _prefix_rows(percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, nodes = [], []
            for node, parts in zip(batch.column("node").to_pylist(), batch.column("parts").to_pylist()):
                hashes = np.frombuffer(b"".join(p["hashes"] for p in parts), np.uint64)
                found = np.frombuffer(b"".join(p["found"] for p in parts), np.uint32)
                length = len(hashes) + (-percent * len(hashes)) // 100 + 1
                prefix = np.lexsort((hashes, found))[:length]
                meet = hashes[prefix[found[prefix] > 1]].astype(np.int64)
                tokens.append(meet), nodes.append(np.full(len(meet), node, np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(np.concatenate(nodes))], names=["token", "node"])

    return rows


def _trie_of_bucket(percent: int):
    def join(group: pa.Table) -> pa.Table:
        by_root: dict[object, dict[int, np.ndarray]] = {}
        for root, node, hashes in zip(*(group.column(c).to_pylist() for c in ("place", "node", "hashes"))):
            by_root.setdefault(root, {})[node] = np.frombuffer(hashes, np.uint64)
        out = []
        for sets in by_root.values():
            nodes = sorted(sets)
            found = jaccard_components([sets[n] for n in nodes], percent)
            out += [(nodes[i], nodes[j]) for i, j in enumerate(found) if i != j]
        return pa.table({"u": pa.array([u for u, _ in out], pa.int64()), "v": pa.array([v for _, v in out], pa.int64())})

    return join


def _to_pivot(percent: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            distance = []
            for own, pivot in zip(batch.column("hashes").to_pylist(), batch.column("pivot_hashes").to_pylist()):
                a, b = np.frombuffer(own, np.uint64), np.frombuffer(pivot, np.uint64)
                common = len(np.intersect1d(a, b, assume_unique=True))
                union = len(a) + len(b) - common
                distance.append((1 - common / union, 100 * common >= percent * union))
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), batch.column("root"), batch.column("pivot"), pa.array([d for d, _ in distance], pa.float64()), pa.array([x for _, x in distance], pa.bool_())],
                names=["node", "root", "pivot", "distance", "linked"],
            )

    return rows


def _without_pivots(sets: DataFrame, roots: DataFrame, percent: int, per_group: int, rounds: int):
    """Groups above per_group elements, thinned out. Jaccard distance is a metric, so with distances to one pivot of the group
    known, a node that links to the pivot matters further only if it lies within the link distance of the nearest node that does
    not. Returns (node, root) still to be worked off, the links found, and whether a group may still be above per_group."""
    links, reach, left_large = None, 1 - percent / 100, True
    sizes = sets.select("node", "n", "hashes")
    for _ in range(rounds):
        grouped = roots.join(sizes.select("node", "n"), "node").groupBy("root").agg(F.sum("n").alias("held"), F.min("node").alias("pivot"))
        large = kept(grouped.where(F.col("held") > per_group), "large")
        if large.isEmpty():
            left_large = False
            break
        pivots = large.join(sizes.select(F.col("node").alias("pivot"), F.col("hashes").alias("pivot_hashes")), "pivot")
        facing = roots.join(sizes, "node").join(pivots.select("root", "pivot", "pivot_hashes"), "root")
        found = kept(facing.select("node", "root", "pivot", "hashes", "pivot_hashes").mapInArrow(
            _to_pivot(percent), "node long, root long, pivot long, distance double, linked boolean"), "pivots")
        new = found.where("linked and node <> pivot").select(F.col("node").alias("u"), F.col("pivot").alias("v"))
        links = new if links is None else links.unionByName(new)
        outside = found.where("not linked").groupBy("root").agg(F.min("distance").alias("nearest"))
        ring = found.where("linked and node <> pivot").join(outside, "root").where(F.col("distance") >= F.col("nearest") - reach - 1e-9)
        left = found.where("not linked").select("node", "root").unionByName(ring.select("node", "root"))
        roots = kept(roots.join(large.select("root"), "root", "left_anti").select("node", "root").unionByName(left), "roots")
    return roots, links, left_large


def _placed(sets: DataFrame, roots: DataFrame, per_group: int, parts: int) -> DataFrame:
    """Each node's set with its group's place. A group that is still above per_group is cut into blocks by node, and every pair of
    its blocks is a place; small groups share a bucket."""
    joined = roots.join(sets, "node")
    sizes = joined.groupBy("root").agg(F.sum("n").alias("held"))
    joined = joined.join(sizes, "root")
    blocks = F.ceil(F.col("held") * 2 / per_group)
    mine = F.pmod(F.xxhash64("node"), blocks)
    pairs = F.when(F.col("held") <= per_group, F.array(F.lit("0"))).otherwise(F.transform(
        F.sequence(F.lit(0).cast("long"), blocks - 1),
        lambda o: F.concat(F.least(mine, o).cast("string"), F.lit(","), F.greatest(mine, o).cast("string"))))
    out = joined.select("node", "hashes", "root", F.explode(pairs).alias("pair")).withColumn("place", F.concat_ws(":", "root", "pair"))
    return out.select("node", "hashes", "place", F.pmod(F.xxhash64("place"), F.lit(parts)).cast("int").alias("bucket"))


def jaccard_classes(docs: DataFrame, n: int = N_WORDS, percent: int = PERCENT, per_bucket: int = PER_BUCKET, per_group: int = PER_GROUP, rounds: int = 4) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text; other columns are ignored).

    Words are cut at ASCII white space after lower-casing A to Z. Rows link when 100 * intersection >= percent * union of their
    n-word shingle sets. component_id is the least doc_id reachable. A text that is null, empty or without words has an empty
    set and is its own component, with component_id its doc_id. Rows with equal doc_id are rows of their own; a null doc_id takes
    part in links, and component_id is then the least doc_id that is not null, or null if there is none. An empty table gives no
    rows. per_bucket, per_group: elements that one task takes; they only cut the work. 64-bit hashes stand for shingles and
    sets."""
    spark, docs = docs.sparkSession, documents_of(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    info = kept(docs.mapInArrow(_set_rows(n, False), "node long, n long, doc_id long"), "sets-info")
    result = info.select("doc_id", F.col("n").alias("n_shingles"), "node")
    total, rows = info.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    alone = result.select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    if not total:
        return alone
    buckets = parts_for(spark, total, per_bucket)

    def dealt(batches):
        yield from _dealt(((node_of(s), s) for b in batches for s in shingle_sets(b.column("text"), n)), buckets, np.uint32)

    counted = docs.select("text").mapInArrow(dealt, _DEALT).groupBy("bucket").applyInArrow(_shared_of_bucket(parts_for(spark, rows, 20_000)), "bin int, nodes binary, counts binary")
    shared = counted.groupBy("bin").applyInArrow(_shared_of_bin, "node long, shared long")
    firsts = info.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"))
    able = shared.join(firsts, "node")
    able = kept(able.where(F.col("shared") * 100 >= F.col("n") * percent), "able")
    near = docs.join(able.select(F.col("doc_id").alias("able_id")), F.col("doc_id").eqNullSafe(F.col("able_id")), "left_semi")
    sets = kept(near.select("text").mapInArrow(_set_rows(n, True), "node long, n long, hashes binary").where("n > 0"), "sets")

    def dealt_sets(batches):
        rows = ((i, np.frombuffer(h, np.uint64)) for b in batches for i, h in zip(b.column("node").to_pylist(), b.column("hashes").to_pylist()))
        yield from _dealt(rows, few, np.uint64)

    held = sets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    few = parts_for(spark, held, per_bucket)
    counted = sets.select("node", "hashes").mapInArrow(dealt_sets, _DEALT).groupBy("bucket").applyInArrow(_frequencies_of_bucket, "node long, hashes binary, found binary")
    meeting = counted.groupBy("node").agg(F.collect_list(F.struct("hashes", "found")).alias("parts"))
    prefixes = kept(meeting.mapInArrow(_prefix_rows(percent), "token long, node long"), "prefixes")
    hubs = prefixes.groupBy("token").agg(F.min("node").alias("hub"))
    roots = components(prefixes.join(hubs, "token").where("node <> hub").select(F.col("node").alias("u"), F.col("hub").alias("v")))
    roots, links, left_large = _without_pivots(sets, roots, percent, per_group, rounds)
    placed = _placed(sets, roots, per_group, parts_for(spark, held, per_bucket // 4))
    joined = placed.groupBy("bucket").applyInArrow(_trie_of_bucket(percent), "u long, v long")
    if links is None and not left_large:  # each group was one task's, which gave every node its representative
        found = joined.select(F.col("u").alias("node"), F.col("v").alias("root"))
    else:
        found = components(joined if links is None else joined.unionByName(links))
    least = firsts.join(found, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("class"))
    smallest = least.groupBy("class").agg(F.min("doc_id").alias("component_id"))
    classes = least.join(smallest, "class").select("node", "component_id")
    return result.join(classes, "node", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
