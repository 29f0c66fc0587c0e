"""The operators as stages of a pipeline: each takes and returns rows with the columns of documents, the last one pieces.

Rows are told apart by doc_id and text together. Stages that filter keep every column as it is. All stages take null values in
any column, rows that repeat, empty tables, and columns of any name beside doc_id and text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.llm import fm_dedup, ngram_join, packing, quality, toxicity
from sieveline.llm.tables import documents_of, kept, table


def _key() -> Column:
    return F.xxhash64(F.col("`doc_id`").cast("long"), F.col("`text`"))


def _whole(docs: DataFrame) -> Column:
    return F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")


def _by_key(docs: DataFrame) -> DataFrame:
    """key as doc_id, and text: what operators get, so that a null or repeated doc_id does no harm."""
    return docs.select(_key().alias("doc_id"), F.col("`text`").alias("text"))


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the ordinal model does not reject. The model is fitted on the labelled rows of docs."""
    texts = documents_of(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    model = toxicity.fit(texts, table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs.select(_whole(docs)), model, carry="whole")
    return scored.where(~F.col("rejected")).select("whole.*")


def reject_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the base rules and have good quality by the posterior. The measures are written with the row they belong to,
    so that the verdict needs no join."""
    rows = docs.select(F.col("`doc_id`").alias("doc_id"), F.col("`text`").alias("text"), _whole(docs))
    return quality.quality(rows, carry=("whole",)).where("kept").select("whole.*")


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: the one with the least doc_id (null last; then the least hash of its text). Rows
    without words are in no group and stay."""
    classes = kept(ngram_join.jaccard_classes(_by_key(docs)), "classes")
    ids = docs.select(_key().alias("doc_id"), F.col("`doc_id`").cast("long").alias("own"))
    rank = F.struct(F.col("own").isNull().alias("n"), F.col("own").alias("o"), F.col("doc_id").alias("k"))
    named = classes.where("n_shingles > 0").select("doc_id", "component_id").distinct().join(ids.distinct(), "doc_id")
    best = named.groupBy("component_id").agg(F.min(rank).alias("best")).select(F.col("best.k").alias("good_key"))
    wordless = classes.where("n_shingles = 0").select(F.col("doc_id").alias("good_key")).distinct()
    good = kept(best.withColumn("words", F.lit(True)).unionByName(wordless.withColumn("words", F.lit(False))), "winners")
    rows = docs.select(_whole(docs), _key().alias("key"))
    stays = rows.join(good.hint("merge"), F.col("key") == F.col("good_key"))  # the same plan at any size
    repeated = classes.where("n_shingles > 0").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("good_key"))
    if not repeated.join(good, "good_key", "left_semi").isEmpty():  # equal rows that both won: one goes on
        one = stays.where("words").groupBy("key").agg(F.min_by("whole", F.to_json("whole")).alias("whole"))
        stays = one.select("whole").unionByName(stays.where("not words").select("whole"))
    return stays.select("whole.*")


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with repeated passages cut from their texts and n_chars, where there is one, to match. A text that repeats nothing
    stays as it is."""
    done = fm_dedup.dedup_substrings(docs, carry=True)
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("carried.text"))
    out = done.select(*(text.alias(c) if c == "text" else F.col(f"carried.`{c}`").alias(c) for c in docs.columns), (F.col("n_removed") > 0).alias("__cut"))
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col("__cut"), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return out.select(*(f"`{c}`" for c in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all rows, as :func:`packing.pack` gives them."""
    return packing.pack(docs).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")
