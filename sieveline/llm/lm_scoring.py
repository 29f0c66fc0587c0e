"""Log-likelihood of whole documents under a gated recurrent language model with a class-factored softmax, learned from the corpus.

The event space is the words of the training documents, one token that ends a document, and one for all unknown words. Counts of all
training words come first. The most frequent words get outputs of their own; the others share the last class, inside which a word's
share is its smoothed count, so that the probabilities of all words add up to one. Training is data-parallel: in each round every
task starts from the same parameters and learns from its documents, and the parameters are averaged by tokens. Each training
document is learned from in one round, whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveline.llm.gated_lm import Model, Shape, Trainer, score, shape_of
from sieveline.llm.tables import documents_of, kept
from sieveline.llm.words import Words, word_chunks

MODEL_WORDS, CLASSES, KNOWN_WORDS = 2000, 48, 1 << 19
ROUNDS = ((0, 1), (1, 4), (4, 16))  # of 16 parts of the training documents: few for the first common ground, most for the last round
_END = np.uint64(0xE0D0C0B0A0908071)  # stands for the hash of the token that ends a document
_GROUP_TOKENS = 1 << 20
SLOTS = 64  # in which parameters of tasks are summed up


def is_held_out() -> F.Column:
    """A null doc_id counts as the text ``null``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))) % 5 == 1


def _distinct(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.unique(hashes, return_inverse=True, return_counts=True)


def word_counts(texts: DataFrame) -> DataFrame:
    """(h, n): how often each word occurs in all rows of texts (text), by its hash; _END for the ends."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, words in word_chunks(batch.column("text"), lower=True):
                h, _, n = _distinct(words.hashes)
                h, n = np.append(h, _END), np.append(n, end - first)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    return texts.mapInArrow(rows, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


class Vocabulary(NamedTuple):
    """The frequent words every task knows: hashes in order, the count and the model's id of each. least: the smallest of these
    counts; n_tokens and n_words: of all training tokens; other: the mass of the last class."""

    hashes: np.ndarray
    counts: np.ndarray
    ids: np.ndarray
    least: int
    n_tokens: int
    n_words: int
    shape: Shape
    top: np.ndarray
    other: float


def vocabulary(counts: DataFrame, model_words: int = MODEL_WORDS, classes: int = CLASSES, known_words: int = KNOWN_WORDS) -> Vocabulary:
    """counts: (h, n) as a written table. At most known_words rows come to the driver, and as many numbers as there are counts."""
    heights = sorted(((r.n, r.words) for r in counts.groupBy("n").agg(F.count("*").alias("words")).collect()), reverse=True)
    n_tokens, n_words = sum(n * w for n, w in heights), sum(w for _, w in heights)
    least, taken = heights[0][0] + 1 if heights else 1, 0
    for n, w in heights:
        if taken + w > known_words:
            break
        least, taken = n, taken + w
    rows = counts.where((F.col("n") >= least) | (F.col("h") == int(_END.view(np.int64)))).toArrow()
    hashes, n = (np.asarray(rows.column(i).combine_chunks()) for i in (0, 1))
    hashes = hashes.view(np.uint64)
    order = np.lexsort((hashes, -n))[:model_words]
    end = np.flatnonzero(hashes == _END)
    if len(order) and end.size and end[0] not in order:
        order[-1] = end[0]  # the last of them anyway: no word has a larger count
    ids = np.full(len(hashes), len(order), np.int32)
    ids[order] = np.arange(len(order))
    top = n[order] + 0.5
    end_id = int(ids[end[0]]) if end.size else len(order)
    other = n_tokens + 0.5 * (n_words + 1) - float(top.sum())
    by_hash = np.argsort(hashes)
    return Vocabulary(hashes[by_hash], n[by_hash], ids[by_hash], least, n_tokens, n_words, shape_of(top, end_id, classes), top, other)


def _encoded(docs: DataFrame, known: Broadcast) -> DataFrame:
    """Each document as ids of the model, with the sums of logs of the smoothed counts over the words every task knows: base_part, and
    other_part for those without an id; rare: hash and number of its other words."""

    def one(v: Vocabulary, words: Words, n_rows: int):
        h, at, _ = _distinct(words.hashes)
        place = np.minimum(np.searchsorted(v.hashes, h), max(len(v.hashes) - 1, 0))
        found = v.hashes[place] == h if len(v.hashes) else np.zeros(len(h), bool)
        ids = np.where(found, v.ids[place], v.shape.words)[at] if len(v.hashes) else np.zeros(len(at), np.int32)
        logs = np.where(found, np.log(v.counts[place] + 0.5), 0.0)[at] if len(v.hashes) else np.zeros(len(at))
        row = np.repeat(np.arange(n_rows), np.diff(words.bounds))
        part = lambda x: np.bincount(row, x, n_rows)
        rare = np.flatnonzero(~found[at])
        return ids, part(logs), part(logs * (ids == v.shape.words)), part(found[at]), part(ids == v.shape.words), rare, row, h[at]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = known.value
        end_at = np.flatnonzero(v.hashes == _END)
        end_count = int(v.counts[end_at[0]]) if len(end_at) else 0
        end_other = v.shape.end == v.shape.words
        for batch in batches:
            for first, end, words in word_chunks(batch.column("text"), lower=True):
                n = end - first
                ids, base, other, n_found, n_other, rare, row, h = one(v, words, n)
                sizes = np.diff(words.bounds) + 1
                stops = np.cumsum(sizes)
                tokens = np.full(stops[-1], v.shape.end, np.int16)
                tokens[np.arange(len(ids)) + row] = ids
                n_rare = np.bincount(row[rare], minlength=n)
                offsets = pa.array(np.concatenate([[0], np.cumsum(n_rare)]), pa.int32())
                binary = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.concatenate([[0], 2 * stops]).astype(np.int32)), pa.py_buffer(tokens)])
                end_log = math.log(end_count + 0.5)
                yield pa.RecordBatch.from_arrays([
                    *(batch.column(c).slice(first, n) for c in ("row", "doc_id", "held_out", "share")), binary, pa.array(sizes.astype(np.int64)),
                    pa.array(base + end_log), pa.array(other + end_log * end_other), pa.array(n_found.astype(np.int64) + (end_count > 0)),
                    pa.array(n_other.astype(np.int64) + end_other), pa.ListArray.from_arrays(offsets, pa.array(h[rare].view(np.int64))),
                ], names=["row", "doc_id", "held_out", "share", "ids", "n_tokens", "base_part", "other_part", "n_found", "n_other", "rare"])

    share = F.pmod(F.xxhash64("doc_id"), F.lit(16)).cast("int")
    named = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", is_held_out().alias("held_out"), share.alias("share"), "text")
    return named.mapInArrow(rows, "row long, doc_id long, held_out boolean, share int, ids binary, n_tokens long, base_part double, "
                                  "other_part double, n_found long, n_other long, rare array<long>")


def _token_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Rows, ids and bounds of groups of documents with some _GROUP_TOKENS together; a longer document is a group of its own."""
    for batch in batches:
        column = batch.column("ids")
        offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) // 2
        ids = np.frombuffer(column.buffers()[2], np.int16) if len(column) else np.zeros(0, np.int16)
        at = 0
        while at < len(column):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _GROUP_TOKENS, "right")) - 1)
            end = min(end, len(column))
            yield batch.column(0).slice(at, end - at), ids[offsets[at] : offsets[end]].astype(np.int64), offsets[at : end + 1] - offsets[at]
            at = end


def _averaged(parts: DataFrame) -> np.ndarray | None:
    """The mean of the parameters, weighted by tokens. Tasks are summed up in SLOTS first, of which the driver gets one row each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, tokens = None, 0
        for batch in batches:
            for vector, n in zip(batch.column("vector"), batch.column("tokens").to_pylist()):
                x = np.frombuffer(vector.as_buffer(), np.float32).astype(np.float64) * n
                total, tokens = x if total is None else total + x, tokens + n
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary()), pa.array([tokens], pa.int64())], names=["vector", "tokens"])

    sums = parts.repartition(SLOTS, "slot").select("vector", "tokens").mapInArrow(rows, "vector binary, tokens long").collect()
    tokens = sum(r.tokens for r in sums)
    return sum(np.frombuffer(r.vector) for r in sums) / tokens if tokens else None


def train(encoded: DataFrame, v: Vocabulary) -> np.ndarray:
    """Parameters of the model, learned from the rows of encoded that are not held out."""
    vector = Model(v.shape).start(v.top, v.other).vector
    context = encoded.sparkSession.sparkContext
    for low, high in ROUNDS:
        start, shape = context.broadcast(vector), v.shape

        def rows(batches: Iterator[pa.RecordBatch], start=start) -> Iterator[pa.RecordBatch]:
            trainer = Trainer(Model(shape, start.value.copy()))
            for _, ids, bounds in _token_groups(batches):
                trainer.learn(ids, bounds)
            if trainer.tokens:
                yield pa.RecordBatch.from_arrays([pa.array([trainer.model.vector.tobytes()], pa.binary()), pa.array([trainer.tokens], pa.int64())], names=["vector", "tokens"])

        part = encoded.where(~F.col("held_out") & (F.col("share") >= low) & (F.col("share") < high)).select("row", "ids")
        learned = part.mapInArrow(rows, "vector binary, tokens long").withColumn("slot", F.spark_partition_id() % SLOTS)
        mean = _averaged(learned)
        vector = vector if mean is None else mean.astype(np.float32)
    return vector


def likelihood(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of docs (doc_id, text; other columns are
    ignored), in log10.

    Tokens are the words, A to Z lower-cased, and one end; a null or empty text is the end alone. The model learns from the rows that
    are not held out (crc32 of doc_id as text, ``null`` if there is none, modulo 5 is not 1). n_known: tokens that occur in these.
    base_score: under their smoothed word counts. score: under the recurrent model, its state carried through the whole document.
    Rows that repeat are rows of their own and all count. Without training rows both scores are 0, the log of the probability of
    the only event; an empty table gives no rows."""
    docs = documents_of(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    counts = kept(word_counts(docs.where(~is_held_out()).select("text")), "word-counts")
    v = vocabulary(counts)
    known = docs.sparkSession.sparkContext.broadcast(v)
    encoded = kept(_encoded(docs, known), "encoded")
    model = docs.sparkSession.sparkContext.broadcast(train(encoded, v))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(known.value.shape, model.value)
        for row, ids, bounds in _token_groups(batches):
            yield pa.RecordBatch.from_arrays([row, pa.array(score(m, ids, bounds))], names=["row", "model_part"])

    scored = encoded.select("row", "ids").mapInArrow(rows, "row long, model_part double")
    # words that not every task knows, which are rare in training: their counts come by a join
    rare = encoded.select("row", F.explode("rare").alias("h")).groupBy("row", "h").agg(F.count("*").alias("times"))
    rare = rare.join(counts.where(F.col("n") < v.least), "h", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    rare = rare.groupBy("row").agg(F.sum(F.col("times") * F.log(F.col("n") + 0.5)).alias("rare_part"), F.sum(F.when(F.col("n") > 0, F.col("times")).otherwise(0)).alias("n_rare"))
    names = [c for c in encoded.columns if c not in ("ids", "rare", "share")]
    joined = encoded.select(*names).join(scored, "row").join(rare, "row", "left").na.fill(0, ["rare_part", "n_rare"])
    all_mass, ten = v.n_tokens + 0.5 * (v.n_words + 1), math.log(10)
    base = F.col("base_part") + F.col("rare_part") - F.col("n_tokens") * math.log(all_mass)
    whole = F.col("model_part") + F.col("other_part") + F.col("rare_part") - F.col("n_other") * math.log(v.other)
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("n_found") + F.col("n_rare")).alias("n_known"), F.lit(v.n_tokens).cast("long").alias("train_tokens"),
        (base / ten).alias("base_score"), (whole / ten).alias("score"),
    )
