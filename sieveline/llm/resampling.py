"""Importance resampling towards a target text: hashed n-gram counts of corpus and target give each bucket a gain, a document's
weight is the sum over its n-grams, and a Gumbel key draws documents without replacement.

The n-grams of a batch are interned in an open-addressed NumPy table: xxhash64 keys say where to look, a comparison of the bytes
says whether it is the same n-gram. The table's slots hold bucket and count, so each distinct n-gram of a batch is hashed into its
bucket once; the slot of each occurrence then gathers its gain.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sieveline.llm.tables import documents_of, kept
from sieveline.llm.words import CHUNK_BYTES, give_back, utf8, window_starts
from sieveline.operators.ordinals import number_rows

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IN_WORD = np.zeros(256, bool)
_IN_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True


class Grams(NamedTuple):
    """Occurrences of n-grams as slices of bytes, the document of each, and the number of words of each document."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    document: np.ndarray
    n_words: np.ndarray


def grams(data: np.ndarray, offsets: np.ndarray, longest: int) -> Grams:
    """All runs of 1 to ``longest`` words within a document, words lower-cased (A to Z) and joined by one space. data: UTF-8 of
    the documents one after the other; offsets: where each begins, and the end."""
    data = _LOWER[data]
    inside = _IN_WORD[data]
    edge = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    inner = np.unique(inner[inside[inner] & inside[inner - 1]])  # a word that would go on into the next document
    starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
    bounds = np.searchsorted(starts, offsets)
    document = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    if longest == 1:
        return Grams(data, starts, ends, document, np.diff(bounds))
    sizes = ends - starts
    to = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    joined = np.full(int((sizes + 1).sum()), 32, np.uint8)
    joined[np.repeat(to - np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes) + np.arange(sizes.sum())] = data[inside]
    at = [(window_starts(bounds, n), n) for n in range(1, longest + 1)]
    first, last = np.concatenate([a for a, _ in at]), np.concatenate([a + n - 1 for a, n in at])
    return Grams(joined, to[first], to[last] + sizes[last], document[first], np.diff(bounds))


def _equal(g: Grams, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether occurrences a and b have the same bytes, pair by pair."""
    sizes = g.ends[a] - g.starts[a]
    same = sizes == g.ends[b] - g.starts[b]
    check = np.flatnonzero(same & (a != b))
    if len(check):
        sizes = sizes[check]
        first = np.concatenate([[0], np.cumsum(sizes)])[:-1]
        step = np.arange(sizes.sum()) - np.repeat(first, sizes)
        equal = g.data[np.repeat(g.starts[a[check]], sizes) + step] == g.data[np.repeat(g.starts[b[check]], sizes) + step]
        same[check] = np.logical_and.reduceat(equal, first)
    return same


class Interned(NamedTuple):
    """slot: of each occurrence. bucket and count: of each slot; a free slot counts 0."""

    slot: np.ndarray
    bucket: np.ndarray
    count: np.ndarray


def intern(g: Grams, buckets: int) -> Interned:
    """Put all occurrences into a table of at most half full, by linear probing. All occurrences take a step together: of those that
    meet a free slot one claims it, and whoever then differs from its slot's owner goes on to the next slot."""
    n, raw = len(g.starts), g.data.tobytes()
    size = 1 << max(4, (2 * n - 1).bit_length() if n else 0)
    keys = np.fromiter((xxh64_intdigest(raw[a:b]) for a, b in zip(g.starts.tolist(), g.ends.tolist())), np.uint64, n)
    place, owner, slot = (keys & np.uint64(size - 1)).astype(np.int64), np.full(size, -1), np.zeros(n, np.int64)
    left = np.arange(n)
    while len(left):
        at = place[left]
        free = owner[at] < 0
        owner[at[free]] = left[free]
        found = owner[at]
        same = keys[found] == keys[left]
        same[same] = _equal(g, left[same], found[same])
        slot[left[same]] = at[same]
        left = left[~same]
        place[left] = (place[left] + 1) & (size - 1)
    bucket = np.zeros(size, np.int64)
    used = np.flatnonzero(owner >= 0)
    bucket[used] = [zlib.crc32(raw[a:b]) % buckets for a, b in zip(g.starts[owner[used]].tolist(), g.ends[owner[used]].tolist())]
    return Interned(slot, bucket, np.bincount(slot, minlength=size))


def _groups(texts: pa.Array, longest: int) -> Iterator[tuple[int, int, Grams]]:
    """(first row, row after the last, n-grams) of groups of rows of some CHUNK_BYTES; a longer text is a group of its own."""
    data, offsets = utf8(texts)
    row = 0
    while row < len(texts):
        end = min(len(texts), max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1))
        yield row, end, grams(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row], longest)
        row = end
    give_back()


def bucket_counts(texts: DataFrame, buckets: int = 10_000, longest: int = 1) -> DataFrame:
    """(bucket, n) over all n-grams of all rows of texts (text). Each task hands on one row for each bucket it has met."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, g in _groups(batch.column("text"), longest):
                table = intern(g, buckets)
                np.add.at(sums, table.bucket, table.count)
        met = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(sums[met])], names=["bucket", "n"])

    counted = documents_of(texts, "text").mapInArrow(rows, "bucket long, n long")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = 10_000, longest: int = 1) -> list[int]:
    """The gain of each bucket: floor of 1000 times the log of the smoothed ratio of its shares in target and docs."""
    s, t = (bucket_counts(x, buckets, longest).withColumnRenamed("n", n) for x, n in ((docs, "s"), (target, "t")))
    both = docs.sparkSession.range(buckets).withColumnRenamed("id", "bucket").join(s, "bucket", "left").join(t, "bucket", "left")
    both = both.select("bucket", *[F.coalesce(n, F.lit(0)).cast("double").alias(n) for n in ("s", "t")])
    sums = F.broadcast(both.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t")))  # one row
    share = ((F.col("t") + 1) * (F.col("all_s") + buckets)) / ((F.col("s") + 1) * (F.col("all_t") + buckets))
    found = both.join(sums).select("bucket", F.floor(1000 * F.log(share)).alias("gain")).collect()  # as many rows as buckets
    return [g for _, g in sorted((r.bucket, r.gain) for r in found)]


def weights(docs: DataFrame, gain: list[int], longest: int = 1) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of every row of docs."""
    of_bucket = docs.sparkSession.sparkContext.broadcast(np.array(gain, np.int64))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.zeros((3, len(batch)), np.int64)
            for first, end, g in _groups(batch.column("text"), longest):
                table = intern(g, len(gain))
                gathered = of_bucket.value[table.bucket][table.slot]
                out[0, first:end] = g.n_words
                out[1, first:end] = np.bincount(g.document, minlength=end - first)
                np.add.at(out[2, first:end], g.document, gathered)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, out)], names=["doc_id", "n_words", "n_features", "weight"])

    rows_of = documents_of(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return rows_of.mapInArrow(rows, "doc_id long, n_words long, n_features long, weight long")


def resample(
    docs: DataFrame, target: DataFrame, percent: int = 10, buckets: int = 10_000, longest: int = 1, least_words: int = 20, seed: int = 2024,
) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs (doc_id, text; target: text; other columns are ignored).

    rank: 1, 2, 3 ... of the ``percent`` of the rows with ``least_words`` words that score highest, ties to the smaller doc_id, then
    to fewer features; null for all other rows. Null doc_id counts as the text ``null`` in the draw and comes last in ties. A null or
    empty text has no features and weight 0. Rows that repeat are rows of their own: equal doc_id gives them the same chance, and
    rows equal in all of it take neighbouring ranks. An empty target gives every bucket the share of an unseen one; an empty
    table gives no rows."""
    scored = weights(docs, gains(docs, target, buckets, longest), longest)
    head = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))), 256), 1, 8)
    uniform = (F.conv(head, 16, 10).cast("double") + 0.5) / 4294967296.0
    score = F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(uniform)))
    all_rows = kept(scored.withColumn("score", score), "scores")
    able = all_rows.where(F.col("n_words") >= least_words)
    drawn = percent * able.count() // 100
    last = F.col("doc_id").isNull()
    ranked = number_rows(able.withColumn("last", last), order=["-score", "last", "doc_id", "n_features"], name="rank")
    names = ["doc_id", "n_features", "weight", "score"]
    rest = all_rows.where(F.col("n_words") < least_words).select(*names, F.lit(None).cast("long").alias("rank"))
    return ranked.select(*names, F.when(F.col("rank") <= drawn, F.col("rank")).alias("rank")).unionByName(rest)
