"""Toxicity by cumulative-link ordinal regression on sparse text features.

Severity has grades 0 to 3. One weight vector is shared by all thresholds: P(grade > k) = sigmoid(w . x - threshold k), thresholds
ascending; expected severity is the sum of these over k. Labels say toxic or not; a toxic training row's grade comes from how many
features that are found mostly in toxic rows it holds, cut at the thirds of the toxic rows.

Features are words and beginnings of words, screened by how much more often toxic rows hold them.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from sieveline.llm.bpe import KeyTable
from sieveline.llm.tables import documents_of
from sieveline.llm.words import BYTE_BASE, CHUNK_BYTES, give_back, lower_letters, mix, slice_hashes, utf8

SAMPLE_ROWS, FEATURES, LEAST_ROWS, LEAST_Z, GRADES = 8000, 4096, 3, 4.0, 4
PREFIXES = (4, 5, 6)


def feature_chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, row after the last, row, feature) of groups of rows: each word, and each beginning of PREFIXES bytes of longer
    words, as often as it occurs. Words are runs of letters, with A to Z as a to z and any byte outside ASCII a letter."""
    data, offsets = utf8(texts)
    row = 0
    while row < len(texts):
        end = min(len(texts), max(row + 1, int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right")) - 1))
        words, bounds = lower_letters(data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row])
        codes, starts, ends = words
        of = np.searchsorted(bounds, np.arange(len(starts)), "right") - 1
        rows, features = [of], [slice_hashes(codes, BYTE_BASE, starts, ends)]
        for k in PREFIXES:
            long = ends - starts > k
            rows.append(of[long]), features.append(mix(slice_hashes(codes, BYTE_BASE, starts[long], starts[long] + k) + np.uint64(k)))
        yield row, end, np.concatenate(rows) + row, np.concatenate(features).astype(np.int64)
        row = end
    give_back()


class Model(NamedTuple):
    """Screened features, their shared weights, and the thresholds between grades."""

    features: np.ndarray
    weights: np.ndarray
    thresholds: np.ndarray


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def severity(linear: np.ndarray, thresholds: np.ndarray) -> np.ndarray:
    """P(grade > k) for each row and each k."""
    return _sigmoid(linear[:, None] - thresholds)


def fit_ordinal(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, grades: np.ndarray, n_columns: int, n_grades: int, penalty: float = 1e-3, rounds: int = 400) -> tuple[np.ndarray, np.ndarray]:
    """Shared weights and ascending thresholds of the cumulative-link model, by gradient steps with momentum and per-parameter
    scale on the log likelihood. Thresholds are a first one and logarithms of the steps after it, so their order can't break."""
    w, raw = np.zeros(n_columns), np.concatenate([[1.0], np.zeros(n_grades - 2)])
    mean, square = (np.zeros(n_columns + n_grades - 1) for _ in range(2))
    n, low, high = max(1, len(grades)), grades - 1, grades
    for step in range(1, rounds + 1):
        thresholds = np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))
        linear = np.bincount(rows, values * w[columns], len(grades))
        above = np.concatenate([np.ones((len(grades), 1)), severity(linear, thresholds), np.zeros((len(grades), 1))], 1)
        slope = above * (1 - above)
        at = np.arange(len(grades))
        chance = np.maximum(above[at, low + 1] - above[at, high + 1], 1e-12)
        by_low, by_high = slope[at, low + 1] / chance, slope[at, high + 1] / chance
        to_linear = -(by_low - by_high) / n
        to_thresholds = np.array([(by_low[low == k].sum() - by_high[high == k].sum()) / n for k in range(n_grades - 1)])
        tail = np.cumsum(to_thresholds[::-1])[::-1]
        grad = np.concatenate([np.bincount(columns, values * to_linear[rows], n_columns) + penalty * w / max(1, n_columns) ** 0.5, tail[:1], tail[1:] * np.exp(raw[1:])])
        mean, square = 0.9 * mean + 0.1 * grad, 0.999 * square + 0.001 * grad**2
        move = 0.1 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w, raw = w - move[:n_columns], raw - move[n_columns:]
    return w, np.cumsum(np.concatenate([raw[:1], np.exp(raw[1:])]))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, features: int = FEATURES) -> Model | None:
    """The model from at most sample_rows labelled rows (those with the smallest hashes of doc_id), or None where they hold no
    toxic or no clean row. At most `features` features, found in LEAST_ROWS toxic rows and LEAST_Z standard errors more often
    there, take part, so what reaches the driver is bounded."""
    marked = labels.select(F.col("`doc_id`").cast("long").alias("doc_id"), F.col("`toxic`").cast("int").alias("toxic")).where("doc_id is not null and toxic in (0, 1)")
    marked = marked.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = docs.sparkSession.createDataFrame([tuple(r) for r in marked.collect()], "doc_id long, toxic int")
    # one row of each doc_id, so that there are sample_rows rows at most and no repeated id outweighs the others
    one = F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")
    train = docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(one).select("text", "toxic")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy()
            for _, _, rows, found in feature_chunks(batch.column("text")):
                pairs = np.unique(np.stack([found, rows]), axis=1)
                values, at = np.unique(pairs[0], return_inverse=True)
                yes = np.bincount(at, toxic[pairs[1]], len(values)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(yes), pa.array(np.bincount(at, minlength=len(values)) - yes)], names=["feature", "toxic", "clean"])

    sizes = {r["toxic"]: r["count"] for r in train.groupBy("toxic").count().collect()}
    yes, no = sizes.get(1, 0), sizes.get(0, 0)
    if not yes or not no:
        return None
    seen = train.mapInArrow(counted, "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    share = (F.col("a") + F.col("b")) / F.lit(float(yes + no))
    z = (F.col("a") / F.lit(float(yes)) - F.col("b") / F.lit(float(no))) / F.sqrt(share * F.greatest(1 - share, F.lit(1e-9)) * (1 / yes + 1 / no))
    best = seen.where(F.col("a") >= LEAST_ROWS).select("feature", z.alias("z")).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "feature").limit(features)
    chosen = np.sort(np.array([r["feature"] for r in best.collect()], np.int64))
    if not len(chosen):
        return None
    table = KeyTable(chosen, np.arange(len(chosen)), -1)

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column("toxic").to_numpy()
            for first, end, rows, found in feature_chunks(batch.column("text")):
                columns = table.get(found)
                keep = columns >= 0
                of = np.searchsorted(np.sort(rows[keep]), np.arange(first, end + 1))
                order = np.argsort(rows[keep], kind="stable")
                mine = columns[keep][order]
                yield pa.RecordBatch.from_arrays([pa.array(toxic[first:end]), pa.array([mine[a:b].tolist() for a, b in zip(of[:-1], of[1:])], pa.list_(pa.int32()))], names=["toxic", "columns"])

    got = train.mapInArrow(sparse, "toxic int, columns array<int>").collect()
    got = sorted(got, key=lambda r: (r["toxic"], r["columns"]))
    toxic, held = np.array([r["toxic"] for r in got]), np.array([len(r["columns"]) for r in got])
    thirds = np.quantile(held[toxic == 1], [1 / 3, 2 / 3])
    grades = np.where(toxic == 1, 1 + (held > thirds[0]).astype(int) + (held > thirds[1]), 0)
    pairs, counts = np.unique(np.array([(i, c) for i, r in enumerate(got) for c in r["columns"]], np.int64).reshape(-1, 2), axis=0, return_counts=True)
    w, thresholds = fit_ordinal(pairs[:, 0], pairs[:, 1], np.log1p(counts), grades, len(chosen), GRADES)
    return Model(chosen, w, thresholds)


def score(docs: DataFrame, model: Model | None, reject_from: float = 0.5, carry: str = "doc_id") -> DataFrame:
    """Rows of docs (text and the column named carry, or a struct carry that holds text) as carry, expected_severity, grade, p_toxic, rejected: see
    :func:`toxicity`."""
    table = KeyTable(model.features, np.arange(len(model.features)), -1) if model else None

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linear = np.zeros(batch.num_rows)
            texts = batch.column("text") if "text" in batch.schema.names else batch.column(carry).field("text")
            for first, end, rows, found in feature_chunks(texts) if model else ():
                columns = table.get(found)
                keep = columns >= 0
                pairs, counts = np.unique(np.stack([rows[keep], columns[keep]]), axis=1, return_counts=True)
                linear[first:end] = np.bincount(pairs[0] - first, np.log1p(counts) * model.weights[pairs[1]], end - first)
            above = severity(linear, model.thresholds) if model else np.zeros((len(linear), GRADES - 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(carry), pa.array(above.sum(1)), pa.array((above >= 0.5).sum(1), pa.int32()), pa.array(above[:, 0])],
                names=[carry, "expected_severity", "grade", "p_toxic"],
            )

    schema = StructType([StructField(carry, docs.schema[carry].dataType)]).add("expected_severity", "double").add("grade", "integer").add("p_toxic", "double")
    return docs.mapInArrow(rows, schema).withColumn("rejected", F.col("p_toxic") >= reject_from)


def toxicity(docs: DataFrame, labels: DataFrame, reject_from: float = 0.5, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, expected_severity, grade, p_toxic, rejected) of every row of docs (doc_id, text), by a model fitted on labels
    (doc_id, toxic 0 or 1); other columns are ignored.

    expected_severity lies between 0 and 3; grade is the number of thresholds passed with probability 0.5; p_toxic is the
    probability of grade 1 or more, and rejected says whether it reaches reject_from. A null or empty text has no features. Labels
    that are null or for unknown rows are left out, of repeated ones the worst counts; without a toxic and a clean labelled row
    nothing is toxic. Rows with equal doc_id, null included, are rows of their own; an empty table gives no rows. Whole texts of
    all rows are scored."""
    docs = documents_of(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    return score(docs, fit(docs, labels, sample_rows), reject_from)
