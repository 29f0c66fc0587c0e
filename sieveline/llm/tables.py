"""Reading the tables and keeping intermediate results where every executor can read them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sieveline.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def kept(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame's rows as a written table in the shared folder: computed once, and a lost executor costs a re-read only."""
    path = shared_folder(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def documents_of(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, in case the table has others whose names clash with ours."""
    return docs.select(*(F.col(f"`{n}`").alias(n) for n in names))


def parts_for(spark: SparkSession, items: int, per_part: int) -> int:
    """How many parts so that each holds about per_part items; never fewer than the cluster has cores for, if there is work."""
    least = min(spark.sparkContext.defaultParallelism, max(1, items // max(1, per_part // 16)))
    return max(least, -(-items // per_part))
