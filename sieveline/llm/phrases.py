"""Phrase collocations by prefix-free parsing: content-triggered overlapping chunks make a dictionary with parse frequencies, and
n-grams are counted inside the distinct chunks, weighted by those.

A piece of text is cut where three words hash to a trigger; a chunk reaches from one trigger to the end of the next, so neighbours
share the three words of a trigger. A chunk owns the positions before its closing trigger: each n-gram of up to four words that
starts there lies inside the chunk, and each n-gram of the text starts at a position that one chunk owns.

Counting goes by length. A phrase that occurs often enough has parts that do, so only n-grams whose two parts of one word less may be
frequent are counted; a bit table of bounded size says so, which never misses a frequent one. Last, frequent phrases are counted by
their text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sieveline.llm.tables import documents_of, kept
from sieveline.llm.words import Words, give_back, mix, run_hashes, split_words, utf8

LONGEST = 4
_OVERLAP = LONGEST - 1
_GROUP_BYTES = 1 << 21
_LEAST_BITS, _MOST_BITS = 20, 29  # 64 MB at most
_BLOCK_BITS = 1 << 15  # of a bitmap as Spark builds it

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ENDS_PIECE = np.zeros(256, bool)
_ENDS_PIECE[[*b".,;:!?", *range(10, 14)]] = True


def _groups(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, bytes, offsets) of groups of rows; a longer text is a group of its own."""
    data, offsets = utf8(texts)
    row = 0
    while row < len(texts):
        end = min(len(texts), max(row + 1, int(np.searchsorted(offsets, offsets[row] + _GROUP_BYTES, "right")) - 1))
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
    give_back()


def _slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The slices of UTF-8 bytes as strings; they may overlap."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    out = data[np.repeat(starts - offsets[:-1], sizes) + np.arange(offsets[-1])]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())


def _joined(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words one after the other with a space between, and where each starts and ends there."""
    sizes = words.ends - words.starts
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    out = np.full(int((sizes + 1).sum()), 32, np.uint8)
    step = np.arange(sizes.sum()) - np.repeat(np.concatenate([[0], np.cumsum(sizes)])[:-1], sizes)
    out[np.repeat(starts, sizes) + step] = words.data[np.repeat(words.starts, sizes) + step]
    return out, starts, starts + sizes


def parse(data: np.ndarray, offsets: np.ndarray, one_in: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Document, text and number of owned positions of each chunk. data: UTF-8 of the documents one after the other."""
    data = _LOWER[data]
    cut = _ENDS_PIECE[data]
    words = split_words(np.where(cut, np.uint8(10), data), offsets, False)
    n = len(words.starts)
    if not n:
        return np.zeros(0, np.int64), pa.array([], pa.string()), np.zeros(0, np.int64)
    cuts = np.cumsum(cut)
    new = np.ones(n + 1, bool)
    new[1:n] = cuts[words.starts[1:] - 1] != cuts[words.ends[:-1] - 1]
    new[words.bounds[:-1][words.bounds[:-1] < n]] = True
    first = np.flatnonzero(new)  # of each piece, and the end
    piece_end = np.repeat(first[1:], np.diff(first))
    trigger = np.zeros(n, bool)
    at = np.flatnonzero(piece_end - np.arange(n) >= _OVERLAP)
    trigger[at] = mix(run_hashes(words.hashes, at, at + _OVERLAP)) % np.uint64(one_in) == 0
    starts = np.flatnonzero(trigger | new[:n])
    following = np.append(starts[1:], n)
    closed = following == piece_end[starts]
    text, word_starts, word_ends = _joined(words)
    last = np.where(closed, following, following + _OVERLAP) - 1
    document = np.searchsorted(words.bounds, starts, "right") - 1
    return document, _slices(text, word_starts[starts], word_ends[last]), following - starts


def dictionary(docs: DataFrame, one_in: int = 16) -> DataFrame:
    """(lang, seed, chunk, owned, n): the distinct chunks of each language with their parse frequency. seed: a hash of lang."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in _groups(batch.column("text")):
                document, chunks, owned = parse(data, offsets, one_in)
                langs = batch.column("lang").slice(first, end - first).take(pa.array(document))
                yield pa.RecordBatch.from_arrays([langs, chunks, pa.array(owned, pa.int64())], names=["lang", "chunk", "owned"])

    named = documents_of(docs, "lang", "text").withColumn("lang", F.coalesce(F.col("lang").cast("string"), F.lit("und")))
    parsed = named.mapInArrow(rows, "lang string, chunk string, owned long")
    found = parsed.groupBy("lang", "chunk", "owned").agg(F.count("*").alias("n"))
    return found.select("lang", F.xxhash64("lang").alias("seed"), "chunk", "owned", "n")


class Chunks:
    """Chunks of a batch as word hashes. Each n-gram is known by a hash of its words and its language."""

    def __init__(self, batch: pa.RecordBatch, first: int, end: int, data: np.ndarray, offsets: np.ndarray):
        self.words = split_words(data, offsets, False)
        bounds, count = self.words.bounds, np.diff(self.words.bounds)
        part = lambda name: batch.column(name).slice(first, end - first).to_numpy(zero_copy_only=False)
        self.left = np.repeat(bounds[1:], count) - np.arange(len(self.words.starts))  # words from here to the end of the chunk
        self.seed = np.repeat(part("seed").view(np.uint64), count)
        self.weight = np.repeat(part("n"), count)
        self.row = np.repeat(np.arange(first, end), count)
        self.owned = np.arange(len(self.words.starts)) - np.repeat(bounds[:-1], count) < np.repeat(part("owned"), count)

    def hashes(self, size: int, at: np.ndarray) -> np.ndarray:
        return mix(run_hashes(self.words.hashes, at, at + size) ^ self.seed[at])

    def starts(self, size: int, shorter: np.ndarray | None) -> np.ndarray:
        """Owned starts of n-grams of a size, of which both parts of one word less may be frequent."""
        fits = self.left >= size
        if shorter is not None:
            at = np.flatnonzero(self.left >= size - 1)
            may = np.zeros(len(self.left) + 1, bool)
            may[at] = _is_set(shorter, self.hashes(size - 1, at))
            fits &= may[:-1] & may[1:]
        return np.flatnonzero(fits & self.owned)


def _is_set(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    at = hashes >> np.uint64(64 - (len(bits) * 8).bit_length() + 1)
    return (bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 > 0


def _sums(hashes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, the sum of the weights of each, and one place of each."""
    order = np.argsort(hashes, kind="stable")
    ordered = hashes[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    return ordered[first], np.add.reduceat(weights[order], first) if len(first) else np.zeros(0, np.int64), order[first]


def _bit_table(chunks: DataFrame, size: int, shorter, least: int):
    """A broadcast table of bits in which the hash of each n-gram of the size with ``least`` occurrences is set. It has 16 bits for
    each, and not more than 2 ** _MOST_BITS, where others are set too, which costs work and changes no result."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in _groups(batch.column("chunk")):
                c = Chunks(batch, *group)
                at = c.starts(size, shorter.value if shorter else None)
                hashes, sums, _ = _sums(c.hashes(size, at), c.weight[at])
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(sums)], names=["h", "n"])

    counted = chunks.select("seed", "chunk", "owned", "n").mapInArrow(rows, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    frequent = kept(counted.where(F.col("n") >= least).select("h"), f"frequent-{size}")
    bits = min(_MOST_BITS, max(_LEAST_BITS, (16 * frequent.count()).bit_length()))
    place = F.shiftrightunsigned("h", 64 - bits) + 1
    blocks = frequent.groupBy(F.bitmap_bucket_number(place).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits"))
    table = np.zeros(1 << (bits - 3), np.uint8)
    for block, found in blocks.collect():  # 2 ** (bits - 15) rows of 4 KB at most
        start = (block - 1) * _BLOCK_BITS // 8
        table[start : start + len(found)] = np.frombuffer(found, np.uint8)
    return chunks.sparkSession.sparkContext.broadcast(table)


def _counted(chunks: DataFrame, tables: list, least: int) -> DataFrame:
    """(lang, phrase, size, a) of the n-grams with ``least`` occurrences, by their text."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group in _groups(batch.column("chunk")):
                c = Chunks(batch, *group)
                for size, table in enumerate(tables, 1):
                    at = c.starts(size, tables[size - 2].value if size > 1 else None)
                    hashes = c.hashes(size, at)
                    may = _is_set(table.value, hashes)
                    at, hashes = at[may], hashes[may]
                    _, sums, one = _sums(hashes, c.weight[at])
                    at = at[one]
                    phrases = _slices(c.words.data, c.words.starts[at], c.words.ends[at + size - 1])
                    langs = batch.column("lang").take(pa.array(c.row[at]))
                    yield pa.RecordBatch.from_arrays([langs, phrases, pa.array(np.full(len(at), size, np.int32)), pa.array(sums)], names=["lang", "phrase", "size", "a"])

    texts = chunks.mapInArrow(rows, "lang string, phrase string, size int, a long")
    return texts.groupBy("lang", "phrase", "size").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def _words_of(first: Column, n: Column) -> Column:
    return F.array_join(F.slice(F.split("phrase", " "), first, n), " ")


def _exact(c: Column) -> Column:
    return c.cast("decimal(38,0)")


def collocations(docs: DataFrame, least: int = 30, top: int = 2000, one_in: int = 16, covered_percent: int = 80) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of 2 to 4 words of each language of docs (lang, text; other columns
    are ignored).

    a: occurrences within pieces of text, ``least`` or more; n: words of the language; l, r: occurrences of the two parts at the cut
    with the least score, floor(2000000 a / (l + r)), ties to the earliest. A phrase inside a longer one that has
    ``covered_percent`` of its occurrences is left out. Ties of score go to the larger a, then to the smaller phrase. A null lang is
    ``und``; a null or empty text has no words; rows that repeat all count; an empty table gives no rows."""
    chunks = kept(dictionary(docs, one_in), "chunks")
    tables: list = []
    for size in range(1, LONGEST + 1):
        tables.append(_bit_table(chunks, size, tables[-1] if tables else None, least))
    words = chunks.groupBy("lang").agg(F.sum(F.col("n") * F.col("owned")).alias("n"))
    return best_phrases(kept(_counted(chunks, tables, least), "phrases"), words, top, covered_percent)


def best_phrases(counted: DataFrame, words: DataFrame, top: int, covered_percent: int) -> DataFrame:
    """What :func:`collocations` returns, from the counts (lang, phrase, size, a) of all frequent phrases, single words included,
    and the number of words (lang, n) of each language."""
    phrases = counted.where(F.col("size") > 1)
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1)))
    cuts = cuts.withColumns({"first": _words_of(F.lit(1), F.col("k")), "rest": _words_of(F.col("k") + 1, F.col("size") - F.col("k"))})
    for part, name in (("first", "l"), ("rest", "r")):
        cuts = cuts.join(counted.select("lang", F.col("phrase").alias(part), F.col("a").alias(name)), ["lang", part])
    score = F.floor(F.expr("cast(a as decimal(38,0)) * 2000000 div (cast(l as decimal(38,0)) + cast(r as decimal(38,0)))"))
    cuts = cuts.withColumn("cut", F.struct(score.alias("score"), "k", "l", "r"))
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min("cut").alias("cut"))

    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("size") - m + 1), lambda i: _words_of(i, m))))
    covers = phrases.where(F.col("size") > 2).select("lang", F.explode(inner).alias("phrase"), "a")
    covers = covers.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    covered = F.coalesce(100 * _exact(F.col("longer")) >= covered_percent * _exact(F.col("a")), F.lit(False))
    stays = scored.join(covers, ["lang", "phrase"], "left").where(~covered).select("lang", "phrase", "a", "cut.*")

    # first within parts of a language, so that the task that ranks a language sees a bounded number of rows
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(64))
    some = stays.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*best))).where(F.col("rank") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
