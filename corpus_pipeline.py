"""From raw documents to packed training sequences: toxic and low-quality rows go, one of each group of near copies stays, passages
that repeat are cut, and what is left is packed. Each stage's rows are written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sieveline.llm import stages
from sieveline.llm.tables import kept, table

STAGES = [
    ("toxicity", stages.reject_toxic),
    ("quality_rules", stages.reject_low_quality),
    ("ngram_join", stages.one_of_each_group),
    ("substring_dedup", stages.cut_repeats),
    ("packing", stages.pack),
]

# Fitted models decide in the first two stages, which SQL cannot restate; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        rows = kept(stage(spark, rows, sf_dir), f"stage-{name}")
    return rows
