"""Row numbers over a whole table, or over each key of it, by distributed prefix sums.

Rows are range-partitioned by key and order, so a key that holds most of the table spreads over as many partitions as it
needs. Rows are counted per partition, and only that small table, one row per partition, is summed up in sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import written

_PLACE_BITS = 33  # of monotonically_increasing_id: the partition stands above them, the row's place in it below


def number_rows(frame: DataFrame, keys=(), order=(), name: str = "ordinal") -> DataFrame:
    """``frame`` with ``name``: 1, 2, 3 ... without gaps, anew for each value of ``keys`` (none: for the whole table).

    ``order`` names columns, a leading ``-`` means descending; nulls come first, or last when descending. Null is a key like any
    other. Rows that are equal in keys and order get a number each, in the order in which they were read. No task holds more
    than a partition, whatever a key's size.
    """
    columns, keys = frame.columns, list(keys)
    inner = {c: f"c{i}" for i, c in enumerate(columns)}
    rows = written(frame.select(
        *[F.col(f"`{c}`").alias(inner[c]) for c in columns], F.monotonically_increasing_id().alias("row")), "numbering")
    key_names = [inner[k] for k in keys]
    by = [*key_names, *[F.desc(inner[o[1:]]) if o.startswith("-") else F.asc(inner[o]) for o in order], "row"]
    at = F.monotonically_increasing_id()
    placed = written(rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("row").select(
        "*", F.shiftright(at, _PLACE_BITS).alias("part"), at.bitwiseAND((1 << _PLACE_BITS) - 1).alias("place")), "placed")
    carried = _carried(placed, key_names)
    inside = Window.partitionBy("part", *key_names)
    start = F.min("place").over(inside) if keys else F.lit(0)
    same = [F.col("part") == F.col("_part")] + [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in key_names]
    number = F.col("place") - F.col("start") + F.coalesce("_carried", F.lit(0)) + 1
    numbered = placed.withColumn("start", start).join(F.broadcast(carried), same, "left").withColumn("number", number)
    return numbered.select(*[F.col(inner[c]).alias(c) for c in columns], F.col("number").alias(name))


def _carried(placed: DataFrame, key_names: list[str]) -> DataFrame:
    """For each partition its first key, and how many rows of that key lie in partitions before it. The table has a row for
    each partition, and so has what the driver sees of it."""
    key = F.struct(F.lit(0), *key_names)
    counts = placed.groupBy("part", *key_names).agg(F.count("*").alias("n")).withColumn("k", key)
    ends = counts.groupBy("part").agg(
        F.min("k").alias("first"), F.max("k").alias("last"), F.max_by("n", "k").alias("n_last"), F.count("*").alias("n_keys"))
    rows, last, run = [], None, 0
    for e in ends.orderBy("part").collect():
        run = run if e["first"] == last else 0
        rows.append((e["part"], run, *tuple(e["first"])[1:]))
        run, last = e["n_last"] + (run if e["n_keys"] == 1 else 0), e["last"]
    fields = [StructField("_part", LongType()), StructField("_carried", LongType())]
    fields += [StructField(f"_{k}", placed.schema[k].dataType) for k in key_names]
    return placed.sparkSession.createDataFrame(rows, StructType(fields))
