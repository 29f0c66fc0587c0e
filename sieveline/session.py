"""Where intermediate tables go."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors share; where that is unset, below the warehouse,
    which they share too."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/sieveline-work"
    return f"{base.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(frame: DataFrame, purpose: str, path: str | None = None) -> DataFrame:
    """The frame's rows as a written table in the shared folder, or at ``path``: computed once, and a lost executor costs a re-read only."""
    path = path or shared_folder(frame.sparkSession, purpose)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def _store(spark: SparkSession, path: str):
    """The file system of a path, as Spark itself reaches it, and the path."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def folders_of(spark: SparkSession, path: str, complete: bool = False) -> list[str]:
    """Names of the folders in a folder, which need not be there; with ``complete`` those that a finished write has marked."""
    store, place = _store(spark, path)
    names = [s.getPath().getName() for s in store.listStatus(place) if s.isDirectory()] if store.exists(place) else []
    return [n for n in names if not complete or store.exists(_store(spark, f"{path}/{n}/_SUCCESS")[1])]


def remove_folder(spark: SparkSession, path: str) -> None:
    """Remove a folder that this library has written."""
    store, place = _store(spark, path)
    store.delete(place, True)
