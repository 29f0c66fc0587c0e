"""Approximate nearest neighbours by inner product: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample. Vectors get one more component that makes all norms equal, so that the largest inner
product is the smallest distance (Bachrach et al., 2014). Every row goes down to a leaf; a query takes nodes from a priority queue
by distance and visits leaves until it has seen as many as calibration asks for. Calibration widens that number until sample
queries reach the recall wanted. Leaves are partitions of the join; a large one is dealt out in chunks.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sieveline.llm.tables import documents_of, kept

K, RECALL, SAMPLE_ROWS, BRANCHES, LEAF_ROWS = 20, 0.97, 20_000, 8, 64
CHUNK_ROWS, CHUNK_QUERIES = 8192, 4096


class Tree(NamedTuple):
    """Centers of all nodes; node i has children first[i] to first[i] + count[i], or is a leaf if count[i] is 0."""

    centers: np.ndarray
    first: np.ndarray
    count: np.ndarray
    largest: float

    def lift(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.maximum(self.largest**2 - (vectors**2).sum(1), 0.0)
        return np.concatenate([vectors, np.sqrt(rest)[:, None]], 1)

    def leaves_of(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf each vector goes down to."""
        x, node = self.lift(vectors), np.zeros(len(vectors), np.int64)
        live = np.arange(len(x))[self.count[node] > 0]
        while len(live):
            for parent in np.unique(node[live]):
                mine = live[node[live] == parent]
                kids = self.centers[self.first[parent] : self.first[parent] + self.count[parent]]
                node[mine] = self.first[parent] + ((kids**2).sum(1) - 2 * x[mine] @ kids.T).argmin(1)
            live = live[self.count[node[live]] > 0]
        return node

    def visits(self, query: np.ndarray) -> Iterator[int]:
        """Leaves in the order of a best-bin-first search."""
        size = np.sqrt((query**2).sum())
        x = np.append(query / size * self.largest if size else query, 0.0)
        queue = [(0.0, 0)]
        while queue:
            _, node = heapq.heappop(queue)
            if not self.count[node]:
                yield node
                continue
            a, b = self.first[node], self.first[node] + self.count[node]
            for d, kid in zip(((self.centers[a:b] - x) ** 2).sum(1).tolist(), range(a, b)):
                heapq.heappush(queue, (d, kid))


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    centers = x[rng.choice(len(x), 1)]
    away = ((x - centers[0]) ** 2).sum(1)
    while len(centers) < k and away.sum() > 0:  # each next center by squared distance to the nearest so far
        centers = np.concatenate([centers, x[rng.choice(len(x), 1, p=away / away.sum())]])
        away = np.minimum(away, ((x - centers[-1]) ** 2).sum(1))
    for _ in range(rounds):
        at = ((centers**2).sum(1) - 2 * x @ centers.T).argmin(1)
        used = np.unique(at)
        centers = np.stack([x[at == i].mean(0) for i in used])
    return centers, ((centers**2).sum(1) - 2 * x @ centers.T).argmin(1)


def build(sample: np.ndarray, largest: float, branches: int = BRANCHES, leaf_rows: int = LEAF_ROWS) -> Tree:
    """A tree over sample vectors: nodes are split in branches until they hold at most leaf_rows, or cannot be told apart."""
    rng = np.random.default_rng(7)
    tree = Tree(np.zeros((0, sample.shape[1] + 1)), np.zeros(0, np.int64), np.zeros(0, np.int64), largest)
    x = tree.lift(sample)
    centers, first, count, todo = [x.mean(0)], [0], [0], [(0, np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if len(rows) <= leaf_rows:
            continue
        kids, at = _k_means(x[rows], branches, rng)
        if len(np.unique(at)) < 2:
            continue
        first[node], count[node] = len(centers), len(kids)
        for i, center in enumerate(kids):
            todo.append((len(centers), rows[at == i]))
            centers.append(center), first.append(0), count.append(0)
    return Tree(np.stack(centers), np.array(first), np.array(count), largest)


def calibrate(tree: Tree, sample: np.ndarray, k: int, recall: float, queries: int = 200) -> int:
    """The least number of leaf visits at which sample queries find `recall` of their k best sample rows."""
    leaf, asked = tree.leaves_of(sample), sample[:: max(1, len(sample) // queries)]
    needed = []
    for query in asked:
        best = np.argsort(-(sample @ query), kind="stable")[: k + 1]
        rank = {node: i for i, node in enumerate(tree.visits(query))}
        needed += [rank[n] + 1 for n in leaf[best].tolist()]
    return int(np.sort(needed)[min(len(needed) - 1, int(np.ceil(recall * len(needed))))]) if needed else 1


def _vectors(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _clean(vectors: DataFrame) -> DataFrame:
    v = F.col("`embedding`").cast("array<double>")
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("`vec_id`").cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & F.coalesce(usable, F.lit(False)))


def nearest(vectors: DataFrame, every: int = 20, k: int = K, recall: float = RECALL, sample_rows: int = SAMPLE_ROWS, leaf_rows: int = LEAF_ROWS,
            chunk_rows: int = CHUNK_ROWS, chunk_queries: int = CHUNK_QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row of vectors (vec_id, embedding; other columns are ignored) whose vec_id is
    divisible by `every`, the k rows found with the largest inner products, ties to the smaller vec_id; score is the inner product
    in double precision.

    Rows with a null vec_id, or an embedding that is null, empty, zero or holds null or non-finite components, take no part; nor
    do rows whose length is not the most frequent one (the greater of equals). A vec_id counts once in a result, with its best
    row; a query is not its own result. With fewer than k candidates all are given; an empty table gives no rows. sample_rows
    bounds what the tree is fitted on; chunk_rows and chunk_queries only cut the work."""
    spark = vectors.sparkSession
    usable = kept(_clean(documents_of(vectors, "vec_id", "embedding")), "vectors")
    sizes = usable.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("norm")).orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes:
        return empty
    usable = usable.where(F.size("v") == sizes[0]["d"])
    drawn = usable.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(sample_rows)  # a bounded sample for the tree
    sample = _vectors(drawn.select("v").toArrow().column("v").combine_chunks())
    tree = build(sample, float(np.sqrt(sizes[0]["norm"])) * (1 + 1e-12), leaf_rows=leaf_rows)
    visits = calibrate(tree, sample, k, recall)
    shared = spark.sparkContext.broadcast(tree)  # grows with sample_rows only

    def with_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = shared.value.leaves_of(_vectors(batch.column("v"))) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("v"), pa.array(leaf, pa.int64())], names=["vec_id", "v", "leaf"])

    placed = kept(usable.mapInArrow(with_leaf, "vec_id long, v array<double>, leaf long"), "leaves")
    held = {r["leaf"]: r["count"] for r in placed.groupBy("leaf").count().collect()}  # leaves of the tree, bounded as it is

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, leaves = [], []
            for i, query in enumerate(_vectors(batch.column("v")) if batch.num_rows else ()):
                seen = taken = 0
                for leaf in shared.value.visits(query):
                    if held.get(leaf):
                        of.append(i), leaves.append(leaf)
                        seen += held[leaf]
                    taken += 1
                    if taken >= visits and seen > 2 * k:
                        break
            at = pa.array(of, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(at), batch.column("v").take(at), pa.array(leaves, pa.int64())], names=["query_id", "q", "leaf"])

    queries = placed.where(F.pmod("vec_id", F.lit(every)) == 0).select("vec_id", "v")
    wanted = kept(queries.mapInArrow(asked, "query_id long, q array<double>, leaf long"), "visits")
    chunks = spark.createDataFrame(
        [(leaf, -(-n // chunk_rows)) for leaf, n in held.items()], "leaf long, row_chunks long"
    ).join(wanted.groupBy("leaf").agg(F.ceil(F.count("*") / chunk_queries).alias("query_chunks")), "leaf")
    rows = placed.join(F.broadcast(chunks), "leaf").select(
        "leaf", "vec_id", "v", F.pmod(F.xxhash64("vec_id", F.lit(1)), "row_chunks").alias("a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("query_chunks") - 1)).alias("b"))
    asks = wanted.join(F.broadcast(chunks), "leaf").select(
        "leaf", "query_id", "q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("row_chunks") - 1)).alias("a"), F.pmod(F.xxhash64("query_id", F.lit(2)), "query_chunks").alias("b"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"query_id": [], "vec_id": [], "score": []}
        if left.num_rows and right.num_rows:
            ids, v = left.column("vec_id").to_numpy(), _vectors(left.column("v").combine_chunks())
            single = len(np.unique(ids)) == len(ids)
            reach = min(k + 1, len(ids)) if single else len(ids)  # a repeated vec_id must not crowd out others
            asking, q = right.column("query_id").to_numpy(), _vectors(right.column("q").combine_chunks())
            for first in range(0, len(q), 256):
                rough = q[first : first + 256] @ v.T
                last = np.partition(rough, -reach, 1)[:, -reach]
                row, col = np.nonzero(rough >= (last - 1e-9 * (1 + np.abs(last)))[:, None])
                score = np.concatenate([(q[first + row[i : i + 65536]] * v[col[i : i + 65536]]).sum(1) for i in range(0, len(row), 65536)])
                other = ids[col] != asking[first + row]
                row, col, score = row[other], col[other], score[other]
                order = np.lexsort((ids[col], -score, row))
                row, col, score = row[order], col[order], score[order]
                place = np.arange(len(row)) - np.searchsorted(row, row)
                near = place < (k if single else len(ids))
                out["query_id"].append(asking[first + row[near]]), out["vec_id"].append(ids[col[near]]), out["score"].append(score[near])
        types = {"query_id": np.int64, "vec_id": np.int64, "score": np.float64}
        return pa.table({n: np.concatenate([*x, np.zeros(0, types[n])]) for n, x in out.items()})

    found = rows.groupBy("leaf", "a", "b").cogroup(asks.groupBy("leaf", "a", "b")).applyInArrow(best, "query_id long, vec_id long, score double")
    single = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return single.select("query_id", place.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
