import datetime as dt
import io
import zipfile

from pyspark.sql import functions as F

from sieveline.functions import json_values as J
from sieveline.functions import text as T
from sieveline.operators import chunks as CH
from sieveline.operators.rule_catalog import Rule, rules_frame
from sieveline.plans import jobs as JB
from sieveline.plans import report as RP
from sieveline.plans import scan as SC
from sieveline.sources.archives import _entries
from sieveline.streaming import runs as ST


def test_marker_in_the_text_is_no_match(spark):
    frame = spark.createDataFrame([("a\x01b\nfind\n\x01",)], "c string")
    assert frame.select(T.match_start_lines("c", "find").alias("n")).first().n == [2]


def test_update_that_is_no_object_changes_nothing(spark):
    frame = spark.createDataFrame([('{"a":1}', "[1]"), ('{"a":1}', '{"b":2}'), (None, '{"b":2}')], "a string, b string")
    assert [r.m for r in frame.select(J.merge(F.col("a"), F.col("b")).alias("m")).collect()] == ['{"a":1}', '{"a":1,"b":2}', '{"b":2}']


def test_damaged_entry_is_a_row_and_the_rest_goes_on():
    import pandas as pd

    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        for name in ("a.java", "b.java", "c.java"):
            z.writestr(name, f"class {name[0]} {{}}")
    data = bytearray(raw.getvalue())
    data[data.index(b"class b")] ^= 1
    rows = pd.concat(_entries([pd.DataFrame({"archive": ["z"], "content": [bytes(data)]})]))
    assert rows.reject_reason.tolist() == [None, "unreadable entry", None] and rows.entry_path.tolist() == ["a.java", "b.java", "c.java"]


def test_stream_expires_what_the_batch_drops(spark, tmp_path):
    rows = [("old", 1, 0, 0), ("again", 2, 0, 0), ("again", 3, 40, None), ("fresh", 4, 30, 30), ("open", 5, 1, None), ("last", 6, 48, None),
            ("edge", 7, 24, 24), ("tie", 8, 2, None), ("tie", 9, 2, 2)]
    schema = "job_id string, event_id int, updated_at timestamp, completed_at timestamp"
    at = lambda h: None if h is None else dt.datetime(2024, 1, 1) + dt.timedelta(hours=h)
    spark.createDataFrame([(j, e, at(u), at(c)) for j, e, u, c in rows], schema).write.parquet(str(tmp_path / "in"))
    states = spark.read.parquet(str(tmp_path / "in"))
    latest = JB.latest_jobs(states, tie="event_id")
    kept = JB.expire_jobs(latest, F.lit(at(48)).cast("timestamp"))
    dropped = latest.join(kept, "job_id", "left_anti").select("job_id", "completed_at")
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    ST.stream_expired_jobs(stream, str(tmp_path / "out"), str(tmp_path / "cp"), lateness="0 seconds").awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, dropped.collect()))
    assert {r.job_id for r in got.collect()} == {"old", "tie"}


def test_rule_table_goes_through_the_one_pass_scan(spark, files, tmp_path):
    own = (Rule("OWN-SEC", "HIGH", r"evil\(", "t", "d", "r", "SECURITY", "OWN", "masked", "line"),
           Rule("OWN-Q", "INFO", "todo", "t", "d", "r", "CODE_QUALITY", "OWN", "raw", "line"))
    source = files({"a.java": "evil() // todo\nnew Random()\n", "src/test/b.java": "evil() // todo\n"}, "j")
    want = [("OWN-Q", "a.java", 1), ("OWN-Q", "src/test/b.java", 1), ("OWN-SEC", "a.java", 1)]
    scans = RP.write_scans(source, str(tmp_path / "scans"), rules=own)
    for found in (SC.all_findings(source, rules=rules_frame(spark, own)), SC.findings_of(scans, rules=own), SC.all_findings(source, rules=own, metrics=False)):
        assert sorted((r.rule_id, r.file_path, r.line_number) for r in found.collect()) == want


def test_failed_jobs_line_up_with_reports(spark):
    failures = spark.sql("SELECT 'j' AS job_id, CAST(NULL AS STRING) AS project_name, TIMESTAMP_NTZ '2024-01-01' AS started_at, "
                         "TIMESTAMP_NTZ '2024-01-02' AS completed_at, 'E' AS error_message")
    requests = failures.select("job_id", "project_name", F.lit(True).alias("include_llm"), "started_at")
    files = spark.createDataFrame([("j", "a.java", "x")], "job_id string, path string, content string")
    reports = RP.build_reports(requests, files, SC.all_findings(files), completed_at=F.lit("2024-01-02").cast("timestamp_ntz"))
    failed = RP.failed_reports(failures)
    assert [(f.name, f.dataType) for f in failed.schema] == [(f.name, f.dataType) for f in reports.schema]
    assert sorted(r.status for r in reports.union(failed).collect()) == ["COMPLETED", "FAILED"]


def test_one_large_file_is_spread_over_prompts(spark):
    table = spark.range(20_000).selectExpr("'j' AS job_id", "'a.java' AS file_path", "CAST(id AS INT) AS chunk_index", "concat('s', id) AS summary")
    got = CH.project_prompts(table, per_prompt=1000, template="{summaries}").collect()
    assert sorted(s for r in got for s in r.prompt.split("\n- ")) == sorted(f"s{i}" for i in range(20_000))
    assert max(r.summaries for r in got) < 3000
