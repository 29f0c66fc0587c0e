"""Job states as an append-only table: save, latest state, look-up, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..session import folders_of

_BATCH = "saved_batch"
STATUS_COLUMNS = ("job_id", "status", "project_name", "started_at", "completed_at", "error_message", "total_findings")


def save_jobs(states: DataFrame, path: str, time: str = "updated_at", files_per_day: int = 8, batch_id: str | None = None) -> str:
    """Append a batch of states, one partition per day, so that reading recent ones prunes by date. The states of a day are dealt
    over ``files_per_day`` tasks, however many tasks they come from, so that a day gets few files and a busy day no hot task.

    A batch has a folder of its own, which is written over when the batch is saved again: a retried append reads as one. Its name is
    ``batch_id``, or else comes from the states themselves, so that equal batches have equal names. Returns it.
    """
    if batch_id is None:
        seen = states.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64(*states.columns).cast("decimal(38,0)")), F.lit(0))).first()
        batch_id = f"{seen[0]}-{int(seen[1]) % 2**64:016x}"
    dated = states.withColumn("updated_on", F.to_date(time)).withColumn("_share", F.pmod(F.xxhash64("job_id", time), F.lit(files_per_day)))
    dealt = dated.repartition("updated_on", "_share").drop("_share")
    dealt.write.mode("overwrite").partitionBy("updated_on").parquet(f"{path}/{_BATCH}={batch_id}")
    return batch_id


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """All states saved. Batches that have not been written to the end are left out."""
    names = [n for n in folders_of(spark, path, complete=True) if n.startswith(f"{_BATCH}=")]
    if not names:
        raise FileNotFoundError(f"no states have been saved in {path}")
    return spark.read.option("basePath", path).parquet(*[f"{path}/{n}" for n in sorted(names)]).drop(_BATCH)


def latest_jobs(states: DataFrame, time: str = "updated_at", tie: str | None = None, key: str = "job_id") -> DataFrame:
    """The last state of every job. Each task hands on one row per job, so a job with very many states is no hot
    spot."""
    rest = [c for c in states.columns if c != key]
    order = F.struct(time, tie) if tie else F.col(time)
    return states.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("_last")).select(key, "_last.*")


def started_at(states: DataFrame) -> DataFrame:
    """First start of every job: a later state keeps the start of the earlier one."""
    return states.groupBy("job_id").agg(F.min("started_at").alias("started_at"))


def job_lookup(jobs: DataFrame, job_id: str) -> DataFrame:
    return jobs.where(F.col("job_id") == job_id)


def job_ids(jobs: DataFrame) -> DataFrame:
    return jobs.select("job_id").distinct()


def job_status(jobs: DataFrame) -> DataFrame:
    """The state without findings."""
    return jobs.select(*STATUS_COLUMNS)


def expire_jobs(jobs: DataFrame, as_of: Column, hours: int = C.JOB_RETENTION_HOURS) -> DataFrame:
    """Drop jobs completed more than ``hours`` before ``as_of``; unfinished jobs stay."""
    cutoff = as_of - F.make_dt_interval(F.lit(0), F.lit(hours), F.lit(0), F.lit(0))
    return jobs.where(F.col("completed_at").isNull() | (F.col("completed_at") >= cutoff))
