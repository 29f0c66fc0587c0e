"""Repeated passages by content: every window of words has an anchor, and windows that are equal have the same one.

A window of w words is placed by the smallest hash among its k-word runs (the leftmost of equals). Neighbouring windows mostly
share that run, so a document becomes a list of segments, one for each anchor, and each window lies in exactly one of them. Equal
windows have equal anchors, so a shard that holds all segments of an anchor decides about them alone. Segments whose anchor occurs
once are done; equal segments count as one with its number of copies. What happens in a shard is the caller's: see
:mod:`fm_dedup` and :mod:`suffix_dedup`.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from sieveline.llm.tables import kept, parts_for
from sieveline.llm.words import Words, give_back, run_hashes, split_words, utf8, window_starts, word_chunks

K = 8
PER_SHARD, PER_ANCHOR = 250_000, 20_000
_SEGMENTS = "row long, start int, n int, anchor int, key long, seg long"


def least_positions(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the smallest of values[i : i + width], the leftmost of equals, for each i up to len(values) - width."""
    at, span = np.arange(len(values)), 1
    while span < width:
        step = min(span, width - span)
        left, right = at[: len(at) - step], at[step:]
        at = np.where(values[right] < values[left], right, left)
        span += step
    return at


def segments(words: Words, window: int, k: int):
    """(first word, word after the last, anchor word, hash of the anchor) of the segments of some documents."""
    starts = window_starts(words.bounds, window)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return none, none, none, np.zeros(0, np.uint64)
    grams = np.arange(len(words.hashes) - k + 1)
    grams = run_hashes(words.hashes, grams, grams + k)
    at = least_positions(grams, window - k + 1)[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    return starts[first], starts[last] + window, at[first], grams[at[first]]


def _anchor_rows(window: int, k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, words in word_chunks(batch.column("text")):
                yield pa.RecordBatch.from_arrays([pa.array(segments(words, window, k)[3].astype(np.int64))], names=["key"])

    return rows


def _segment_rows(window: int, k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first_row, end_row, words in word_chunks(batch.column("text")):
                start, end, anchor, key = segments(words, window, k)
                doc = np.searchsorted(words.bounds, start, "right") - 1
                own = pa.array(doc + first_row)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("row").take(own), pa.array((start - words.bounds[doc]).astype(np.int32)),
                        pa.array((end - start).astype(np.int32)), pa.array((anchor - start).astype(np.int32)), pa.array(key.astype(np.int64)),
                        pa.array(run_hashes(words.hashes, start, end).astype(np.int64)),
                    ],
                    names=["row", "start", "n", "anchor", "key", "seg"],
                )

    return rows


def _texts_with(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """docs joined to marks (row, ...), which has each row number once at most. The plan is the same at any size."""
    marks = marks.withColumnRenamed("row", "of_row").hint("merge")
    return docs.join(marks, docs.row == marks.of_row, how).drop("of_row")


def _word_rows(windows_only: int):
    """Words of the wanted segments of each document; with windows_only, the hashes of their windows of so many words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"key": [], "seg": [], "copies": [], "anchor": []} | ({"at": [], "hash": []} if windows_only else {"words": []})
            for i, wanted in enumerate(batch.column("wanted").to_pylist()):
                hashes = split_words(*utf8(batch.column("text").slice(i, 1)), False).hashes
                for s in wanted:
                    piece = hashes[s["start"] : s["start"] + s["n"]]
                    if windows_only:
                        at = np.arange(len(piece) - windows_only + 1)
                        out["at"] += at.tolist()
                        out["hash"] += run_hashes(piece, at, at + windows_only).astype(np.int64).tolist()
                    else:
                        out["words"].append(piece.tobytes())
                    for name in ("key", "seg", "copies", "anchor"):
                        out[name] += [s[name]] * (len(at) if windows_only else 1)
            types = {"key": pa.int64(), "seg": pa.int64(), "copies": pa.int64(), "anchor": pa.int32(), "words": pa.binary(), "at": pa.int32(), "hash": pa.int64()}
            yield pa.RecordBatch.from_pydict({c: pa.array(v, types[c]) for c, v in out.items()})

    return rows


def _shard_rows(decide: Callable, window: int):
    def rows(group: pa.Table) -> pa.Table:
        pieces = [np.frombuffer(w, np.uint64) for w in group.column("words").to_pylist()]
        values, symbols = np.unique(np.concatenate(pieces), return_inverse=True)
        pieces = np.split((symbols + 1).astype(np.int32), np.cumsum([len(p) for p in pieces])[:-1])
        copies, anchors = (group.column(c).to_numpy() for c in ("copies", "anchor"))
        spans = decide(pieces, copies, anchors, window, len(values))
        found = [i for i, s in enumerate(spans) if len(s)]
        return pa.table({
            "key": group.column("key").take(found), "seg": group.column("seg").take(found),
            "spans": pa.array([spans[i].ravel().tolist() for i in found], pa.list_(pa.int32())),
        })

    return rows


def covered_spans(starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The union of spans [start, end) as rows of disjoint spans in order."""
    if not len(starts):
        return np.zeros((0, 2), np.int64)
    order = np.argsort(starts, kind="stable")
    starts, reach = starts[order], np.maximum.accumulate(ends[order])
    new = np.append(True, starts[1:] > reach[:-1])
    return np.stack([starts[new], reach[np.append(np.flatnonzero(new)[1:], len(starts)) - 1]], 1)


def _python_rows(*columns: pa.Array) -> Iterator[tuple]:
    """Values of some columns row by row, made for a few rows at a time."""
    for first in range(0, len(columns[0]), 256):
        yield from zip(*(c.slice(first, 256).to_pylist() for c in columns))
    give_back()


def _cut_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = {"carried": batch.column("carried"), "n_words": [], "n_removed": [], "kept": [], "spans": []}
        texts = batch.column("text") if "text" in batch.schema.names else batch.column("carried").field("text")
        for text, marks in _python_rows(texts, batch.column("marks")):
            words = (text or "").encode().split()
            flat = [(m["start"] + a, m["start"] + b) for m in marks or () for a, b in zip(m["spans"][::2], m["spans"][1::2])]
            spans = covered_spans(*np.array(flat, np.int64).reshape(-1, 2).T)
            stays = np.ones(len(words), bool)
            for a, b in spans:
                stays[a:b] = False
            out["n_words"].append(len(words)), out["n_removed"].append(len(words) - int(stays.sum()))
            out["kept"].append(b" ".join(compress(words, stays) if len(spans) else words).decode())
            out["spans"].append([{"start": a, "end": b} for a, b in spans.tolist()])
        yield pa.RecordBatch.from_pydict(out, schema=pa.schema(
            [("carried", batch.schema.field("carried").type), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()),
             ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]))


def without_repeats(docs: DataFrame, decide: Callable, window: int, k: int = K, per_shard: int = PER_SHARD, per_anchor: int = PER_ANCHOR, carry: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, spans) of every row of docs (doc_id, text; other columns are ignored).

    spans are the word ranges [start, end) covered by a window of `window` words whose sequence also starts anywhere else, in this
    row or another; kept is the other words, joined by one space. decide gets a shard's distinct segments as arrays of word
    numbers, with copies and anchors, and gives the spans of each segment whose windows occur twice. A null text counts as empty;
    a row with fewer words than a window keeps all; rows with equal doc_id, null included, are rows of their own; an empty table
    gives no rows. A row is known by the 64-bit hash of its doc_id and text. carry: the first column is `carried` instead, a struct of all columns of docs.

    per_shard: words in a shard, about. An anchor with more distinct segments than per_anchor is not put in one shard: its windows
    are grouped by their own hash instead, with partial counts, which gives the same answer. Both only cut the work."""
    spark = docs.sparkSession
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)) if carry else F.col("`doc_id`").cast("long")
    row = F.xxhash64(F.col("`doc_id`").cast("long"), F.col("`text`"))
    docs = docs.select(F.col("`text`").alias("text"), whole.alias("carried"), row.alias("row"))
    anchors = docs.select("text").mapInArrow(_anchor_rows(window, k), "key long")
    met = kept(anchors.groupBy("key").count().where("count > 1").select("key"), "anchors")
    rows = kept(docs.select("row", "text").mapInArrow(_segment_rows(window, k), _SEGMENTS).join(met.hint("merge"), "key", "left_semi"), "repeated")
    distinct = rows.groupBy("key", "seg", "n", "anchor").agg(F.count("*").alias("copies"), F.min(F.struct("row", "start")).alias("of"))
    distinct = kept(distinct, "distinct")
    groups = distinct.groupBy("key").agg(F.count("*").alias("segs"), F.sum("n").alias("held"))
    mixed = kept(groups.where("segs > 1"), "mixed")
    alone = distinct.where("copies > 1").join(mixed, "key", "left_anti").select("key", "seg", F.array(F.lit(0), F.col("n")).alias("spans"))
    large, held = mixed.agg(F.count_if(F.col("segs") > per_anchor), F.coalesce(F.sum(F.when(F.col("segs") <= per_anchor, F.col("held"))), F.lit(0))).first()
    wanted = distinct.join(mixed, "key").select("of.*", F.struct(F.col("of.start").alias("start"), "n", "anchor", "key", "seg", "copies").alias("s"), (F.col("segs") > per_anchor).alias("large"))

    def pieces(of_large: bool, schema: str, windows_only: int = 0) -> DataFrame:
        by_row = wanted.where(F.col("large") == of_large).groupBy("row").agg(F.collect_list("s").alias("wanted"))
        once = docs.select("row", "text").dropDuplicates(["row"])  # equal rows meet before they move
        return _texts_with(once, by_row, "inner").select("text", "wanted").mapInArrow(_word_rows(windows_only), schema)

    found = alone
    if held:
        shards = parts_for(spark, held, per_shard)
        words = pieces(False, "key long, seg long, copies long, anchor int, words binary")
        shard = words.withColumn("shard", F.pmod("key", F.lit(shards)).cast("int")).groupBy("shard")
        found = found.unionByName(shard.applyInArrow(_shard_rows(decide, window), "key long, seg long, spans array<int>"))
    if large:
        hot = kept(pieces(True, "key long, seg long, copies long, anchor int, at int, hash long", window), "windows")
        twice = hot.groupBy("hash").agg(F.sum("copies").alias("times")).where("times > 1").select("hash")
        found = found.unionByName(
            hot.join(twice, "hash", "left_semi").groupBy("key", "seg").agg(F.flatten(F.collect_list(F.array("at", F.col("at") + window))).alias("spans"))
        )
    # a set: rows that are equal mark the same places, however many they are
    marks = rows.join(found, ["key", "seg"]).groupBy("row").agg(F.collect_set(F.struct("start", "spans")).alias("marks"))
    marked = _texts_with(docs, kept(marks, "marks"), "left").select("carried", *([] if carry else ["text"]), "marks")
    span = StructType().add("start", "long").add("end", "long")
    schema = StructType([StructField("carried", docs.schema["carried"].dataType)]).add("n_words", "long").add("n_removed", "long").add("kept", "string").add("spans", ArrayType(span))
    out = marked.mapInArrow(_cut_rows, schema)
    return out if carry else out.withColumnRenamed("carried", "doc_id")
