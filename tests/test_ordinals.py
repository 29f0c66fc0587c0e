from collections import defaultdict

from pyspark.sql import functions as F

from sieveline.operators.ordinals import number_rows


def test_numbers_have_no_gaps_and_follow_the_order(spark):
    key = F.when(F.col("id") < 7000, "hot").when(F.col("id") < 8000, None).otherwise((F.col("id") % 7).cast("string"))
    rows = spark.range(10_000).select(key.alias("job.x"), (F.col("id") * 7919 % 500).alias("v"), F.lit("x").alias("part"))
    for keys, order, descending in (([], ["-v"], True), (["job.x"], ["v"], False), (["job.x", "part"], ["-v"], True), (["part"], [], None)):
        out = number_rows(rows, keys, order)
        assert out.columns == ["job.x", "v", "part", "ordinal"]
        groups = defaultdict(list)
        for r in out.collect():
            groups[tuple(r[k] for k in keys)].append((r.ordinal, r.v))
        for numbered in groups.values():
            numbered.sort()
            assert [n for n, _ in numbered] == list(range(1, len(numbered) + 1))
            if descending is not None:
                values = [v for _, v in numbered]
                assert values == sorted(values, reverse=descending)


def test_equal_rows_and_empty_tables(spark):
    rows = spark.range(3000).select(F.lit(None).cast("string").alias("k"), F.lit(1).alias("v"))
    assert sorted(r.ordinal for r in number_rows(rows, ["k"], ["v"]).collect()) == list(range(1, 3001))
    assert number_rows(rows.limit(0), ["k"], ["v"]).count() == 0 == number_rows(rows.limit(0)).count()


def test_a_key_with_all_rows_is_spread_over_tasks(spark):
    rows = spark.range(20_000).select(F.lit("all").alias("k"), "id")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # else so few rows go to one task
    try:
        numbered = number_rows(rows, ["k"], ["id"])
        per_task = numbered.select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
        assert sorted(r.ordinal for r in numbered.collect()) == list(range(1, 20_001))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(per_task) > 1 and max(r["count"] for r in per_task) < 10_000
