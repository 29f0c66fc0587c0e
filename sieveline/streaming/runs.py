"""Streaming queries. Each runs over what is there and stops (``availableNow``) unless another trigger is given."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import constants as C
from ..plans.jobs import expire_jobs, latest_jobs
from ..plans.scan import security_scan
from ..session import folders_of, remove_folder


def _start(writer, trigger: dict | None):
    return writer.trigger(**(trigger or {"availableNow": True})).start()


def stream_security_scan(files: DataFrame, out: str, checkpoint: str, trigger: dict | None = None):
    """Scan arriving files into a Parquet table. Matching is stateless: hits are distinct within a file, and a file
    arrives once, so no state has to be kept for deduplication."""
    findings = security_scan(files, paths_unique=True)
    return _start(findings.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint), trigger)


def stream_latest_status(
    states: DataFrame, out: str, checkpoint: str, time: str = "updated_at", tie: str = "event_id", trigger: dict | None = None,
    compact_every: int = 10, retention_hours: int | None = None,
):
    """Keep the latest state per job below ``out``.

    The stream itself has no state. Every micro-batch writes the latest state of each of its jobs under its own number, and every
    ``compact_every`` batches what is there becomes one snapshot, the newest state of a job winning, so that folders stay few
    however long the stream runs. Batches and snapshots are written over when they are written again, and what a snapshot was made
    from goes only with the next one, so retries do no harm. With ``retention_hours`` a snapshot leaves out jobs that were
    completed longer ago than that, seen from its newest state.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        latest_jobs(batch, time, tie).write.mode("overwrite").parquet(f"{out}/batch-{batch_id}")
        if (batch_id + 1) % compact_every:
            return
        before = batch_id - compact_every
        parts = [p for p in _parts(spark, out) if p[1] > before or p == ("snapshot", before)]
        merged = latest_jobs(_read(spark, out, [p for p in parts if p[1] <= batch_id and p != ("snapshot", batch_id)]), time, tie)
        if retention_hours is not None:
            now = merged.agg(F.max(time)).first()[0]
            merged = expire_jobs(merged, F.lit(now).cast(merged.schema[time].dataType), retention_hours)
        merged.write.mode("overwrite").parquet(f"{out}/snapshot-{batch_id}")
        for part in _parts(spark, out):
            if part not in parts and part != ("snapshot", batch_id):
                remove_folder(spark, f"{out}/{part[0]}-{part[1]}")

    return _start(states.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint), trigger)


def _parts(spark: SparkSession, out: str) -> list[tuple[str, int]]:
    """Kind and number of the batches and snapshots that are complete."""
    names = [n.rsplit("-", 1) for n in folders_of(spark, out, complete=True)]
    return sorted((kind, int(number)) for kind, number in names if kind in ("batch", "snapshot"))


def _read(spark: SparkSession, out: str, parts: list[tuple[str, int]]) -> DataFrame:
    return spark.read.parquet(*[f"{out}/{kind}-{number}" for kind, number in parts])


def read_latest_status(spark: SparkSession, out: str, time: str = "updated_at", tie: str = "event_id") -> DataFrame:
    """The newest version of every job: the last snapshot and the batches after it."""
    parts = _parts(spark, out)
    last = max((n for kind, n in parts if kind == "snapshot"), default=-1)
    return latest_jobs(_read(spark, out, [p for p in parts if p == ("snapshot", last) or p[0] == "batch" and p[1] > last]), time, tie)


def _retention(hours: int):
    """Keyed state: order and completion of a job's latest state, with a timer at the end of its retention."""

    def advance(key, batches, state):
        if state.hasTimedOut:
            completed = state.get[2]
            state.remove()
            yield pd.DataFrame({"job_id": [key[0]], "completed_us": [completed]})
            return
        last = tuple(state.get) if state.exists else None
        for rows in batches:
            newest = rows.sort_values(["order_us", "tie"]).iloc[-1]
            done = None if pd.isna(newest.completed_us) else int(newest.completed_us)
            candidate = (int(newest.order_us), int(newest.tie), done)
            last = candidate if last is None or candidate[:2] >= last[:2] else last
        state.update(last)
        if last[2] is not None:
            state.setTimeoutTimestamp(max(last[2] // 1000 + hours * 3_600_000, state.getCurrentWatermarkMs() + 1))

    return advance


def expired_jobs(
    states: DataFrame, hours: int = C.JOB_RETENTION_HOURS, time: str = "updated_at", tie: str = "event_id", lateness: str = "1 hour"
) -> DataFrame:
    """Stream of (job_id, completed_at): the jobs whose latest state is completed and has passed its retention.

    What comes out is what ``expire_jobs`` drops from the latest states as of the newest state less ``lateness``. A job
    leaves the state as it comes out; unfinished jobs stay, as they may still finish.
    """
    micros = F.unix_micros(F.col("completed_at").cast("timestamp")).alias("completed_us")
    at = F.col(time).cast("timestamp")
    slim = states.where(F.col(time).isNotNull()).select(
        "job_id", at.alias("at"), F.unix_micros(at).alias("order_us"), F.coalesce(F.col(tie).cast("bigint"), F.lit(-1)).alias("tie"), micros
    )
    expired = slim.withWatermark("at", lateness).groupBy("job_id").applyInPandasWithState(
        _retention(hours), "job_id string, completed_us bigint", "order_us bigint, tie bigint, completed_us bigint", "append", "EventTimeTimeout"
    )
    return expired.select("job_id", F.timestamp_micros("completed_us").alias("completed_at"))


def stream_expired_jobs(states: DataFrame, out: str, checkpoint: str, trigger: dict | None = None, **options):
    writer = expired_jobs(states, **options).writeStream.outputMode("append").format("parquet")
    return _start(writer.option("path", out).option("checkpointLocation", checkpoint), trigger)
