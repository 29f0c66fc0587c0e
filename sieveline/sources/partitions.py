"""How many tasks a scan gets."""

from __future__ import annotations

from pyspark.sql import DataFrame

TASK_ROWS = 20_000
_STREAM_TASKS_PER_CORE = 16


def spread(frame: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """Deal an input out evenly before heavy per-row work, in tasks of ``task_rows`` rows at most, and a task a core at least.

    Text work costs far more CPU per byte than reading does, and how a table is split says little: a Parquet file of many splits may
    have its rows in a few large row groups, each of which goes to one task. So the number of tasks comes from the number of rows,
    which Parquet tells without reading them. How many rows a batch of a stream has is not known: it gets a fixed number of tasks.
    """
    cores = frame.sparkSession.sparkContext.defaultParallelism
    if frame.isStreaming:
        return frame.repartition(cores * _STREAM_TASKS_PER_CORE)
    return frame.repartition(max(cores, -(-frame.count() // task_rows)))
