"""Stores that can be written again: job states in batches, the latest status of a long stream, ranked pages."""

import os

from pyspark.sql import functions as F

from sieveline.operators import chunks as CH
from sieveline.plans import jobs as JB
from sieveline.plans import report as RP
from sieveline.session import folders_of
from sieveline.streaming import runs as ST


def states(spark, n, jobs=7):
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60)
    return spark.range(n).select(
        F.concat(F.lit("j"), (F.col("id") % jobs).cast("string")).alias("job_id"), F.col("id").alias("event_id"), at.alias("updated_at"),
        F.when(F.col("id") % 5 == 0, "COMPLETED").otherwise("RUNNING").alias("status"), F.when(F.col("id") % 5 == 0, at).alias("completed_at"))


def test_a_batch_saved_again_reads_as_once(spark, tmp_path):
    path, all_states = str(tmp_path / "jobs"), states(spark, 500)
    first, second = all_states.where("event_id < 300"), all_states.where("event_id >= 300")
    names = [JB.save_jobs(s, path) for s in (first, second, first.repartition(3), first)]
    assert names[0] == names[2] == names[3] != names[1]
    JB.save_jobs(second.withColumn("status", F.lit("FAILED")), path, batch_id=names[1])  # a retry that came to other states replaces
    saved = JB.read_jobs(spark, path)
    assert set(saved.columns) == {*all_states.columns, "updated_on"}
    assert saved.count() == 500 and saved.where("status = 'FAILED'").count() == 200
    plan = saved.where("updated_on = '2023-11-14'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(updated_on" in plan


def test_a_batch_that_was_not_finished_is_not_read(spark, tmp_path):
    path = str(tmp_path / "jobs")
    JB.save_jobs(states(spark, 100), path, batch_id="a")
    JB.save_jobs(states(spark, 50), path, batch_id="b")
    os.remove(f"{path}/saved_batch=b/_SUCCESS")
    assert JB.read_jobs(spark, path).count() == 100
    JB.save_jobs(states(spark, 50), path, batch_id="b")
    assert JB.read_jobs(spark, path).count() == 150


def test_latest_status_stays_small_over_a_hundred_batches(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        states(spark, 1000).repartition(100).write.parquet(source)
        stream = spark.readStream.schema(states(spark, 1).schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = ST.stream_latest_status(stream, out, checkpoint, compact_every=8)
        most = 0
        while not query.awaitTermination(1):
            most = max(most, len(folders_of(spark, out)))
        assert query.lastProgress is not None and not query.lastProgress.stateOperators  # the stream keeps no state
        names = folders_of(spark, out)
        assert max(most, len(names)) <= 2 * 8 + 3 and sum(n.startswith("snapshot") for n in names) <= 2
        got = {r.job_id: r.event_id for r in ST.read_latest_status(spark, out).collect()}
        assert got == {f"j{i % 7}": i for i in range(993, 1000)}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")


def test_snapshots_forget_jobs_past_their_retention(spark, tmp_path):
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "cp"))
    all_states = states(spark, 400, jobs=40)
    for i in range(4):
        all_states.where(F.col("event_id").between(100 * i, 100 * i + 99)).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(all_states.schema).option("maxFilesPerTrigger", 1).parquet(source)
    ST.stream_latest_status(stream, out, checkpoint, compact_every=4, retention_hours=0).awaitTermination()
    got = {r.job_id for r in ST.read_latest_status(spark, out).collect()}
    newest = {f"j{i % 40}": i for i in range(400)}
    assert got == {j for j, i in newest.items() if i % 5}


def test_pages_are_full_where_findings_are_equal(spark):
    n = 10_007
    finding = {"severity": "LOW", "category": "CODE_QUALITY", "title": "t", "description": "d", "recommendation": "r", "file_path": "f", "rule_id": "R", "source": "S"}
    rows = spark.range(n).select(F.lit("j").alias("job_id"), *[F.lit(v).alias(k) for k, v in finding.items()], F.lit(1).alias("line_number"))
    one = rows.limit(1).withColumn("severity", F.lit("CRITICAL")).withColumn("category", F.lit("SECURITY"))
    pages = RP.finding_pages(rows.unionByName(one), page_size=1000).collect()
    sizes = {p.page: len(p.quality_findings) + len(p.security_findings) + len(p.architecture_findings) for p in pages}
    assert sizes == {**{i: 1000 for i in range(10)}, 10: 8} and {p.pages for p in pages} == {11}
    assert [len(p.security_findings) for p in sorted(pages, key=lambda p: p.page)] == [1] + [0] * 10


def test_ordinals_of_one_large_project(spark):
    n = 50_000
    rows = spark.range(n).select(
        F.lit("j").alias("job_id"), F.format_string("f%02d", F.col("id") % 20).alias("file_path"), F.floor(F.col("id") / 20).cast("int").alias("chunk_index"),
        F.col("id").cast("string").alias("summary"))
    got = CH.project_bullets(rows)
    assert got.agg(F.count_distinct("ordinal"), F.min("ordinal"), F.max("ordinal")).first() == (n, 1, n)
    at = {r.bullet: r.ordinal for r in got.collect()}
    assert all(at[str(i)] == (i % 20) * (n // 20) + i // 20 + 1 for i in range(0, n, 997))
