import json

import pytest
from pyspark.sql import functions as F

from fixtures import scan_queries, table_queries  # noqa: F401
from fixtures.registry import QUERIES
from fixtures.source_tables import BIG_AT, BIG_EVERY, DIRECTORIES, EXTENSIONS, N
from sieveline.operators import chunks as CH
from sieveline.operators import replies as R
from sieveline.plans import report as RP


def _findings(spark, n, title):
    return spark.range(n).select(
        F.lit("j").alias("job_id"), F.lit("LOW").alias("severity"), F.lit("SECURITY").alias("category"), F.lit(title).alias("title"),
        F.concat(F.lit("d"), F.col("id").cast("string")).alias("description"), F.lit("r").alias("recommendation"), F.lit("f").alias("file_path"),
        F.lit(1).alias("line_number"), F.lit("R").alias("rule_id"), F.lit("s").alias("source"))


def test_job_without_findings_on_the_first_page_keeps_its_report_head(spark):
    spot = F.pmod(F.xxhash64(F.lit("f"), F.lit("R"), F.lit(1), "title"), F.lit(2))
    title = spark.range(50).select(F.concat(F.lit("t"), F.col("id").cast("string")).alias("title")).where(spot == 1).first().title
    found = _findings(spark, 11, title)
    requests = spark.createDataFrame([("j", "P", True)], "job_id string, project_name string, include_llm boolean")
    requests = requests.withColumn("started_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    files = spark.createDataFrame([("j", "f", "x")], "job_id string, path string, content string")
    documents = RP.report_json(RP.build_reports(requests, files, found), RP.finding_pages(found, page_size=10)).collect()
    pages = {r.page: json.loads(r.json) for r in documents}  # equal findings too are parted at the size of a page
    assert sorted(pages) == [0, 1] and [len(pages[i]["security_findings"]) for i in (0, 1)] == [10, 1]
    assert (pages[0]["total_findings"], pages[0]["pages"], pages[0]["status"]) == (11, 2, "COMPLETED") and "status" not in pages[1]


def test_pages_are_numbered_without_gaps(spark):
    """2 places on 40 possible pages."""
    found = _findings(spark, 200, "a").unionByName(_findings(spark, 200, "b"))
    rows = RP.finding_pages(found, page_size=10).collect()
    assert sorted(r.page for r in rows) == list(range(len(rows))) and {r.pages for r in rows} == {len(rows)}
    assert sum(len(r.security_findings) for r in rows) == 400


def _summaries(spark, n):
    return spark.range(n).selectExpr(
        "'j' AS job_id", "concat('f', lpad(CAST(id % 7 AS STRING), 2, '0')) AS file_path", "CAST(id DIV 7 AS INT) AS chunk_index", "concat('s', id) AS summary")


def _in_order(n):
    return [f"s{i}" for i in sorted(range(n), key=lambda i: (i % 7, i // 7))]


def test_project_prompt_is_one_at_any_size(spark):
    rows = CH.project_prompts(_summaries(spark, 12_000), template="{summaries}").collect()
    assert [(r.part, r.parts, r.summaries) for r in rows] == [(0, 1, 12_000)] and rows[0].prompt.split("\n- ") == _in_order(12_000)


def test_bullets_are_numbered_without_gaps_and_pages_follow_them(spark):
    bullets = CH.project_bullets(_summaries(spark, 12_000))
    got = sorted((r.ordinal, r.bullet) for r in bullets.collect())
    assert got == list(enumerate(_in_order(12_000), 1))
    pages = sorted(CH.prompt_pages(bullets, 5000, template="{summaries}").collect())
    assert [(r.part, r.parts, r.summaries) for r in pages] == [(0, 3, 5000), (1, 3, 5000), (2, 3, 2000)]
    assert [s for r in pages for s in r.prompt.split("\n- ")] == _in_order(12_000)
    nulls = spark.createDataFrame([(None, None, None, "a"), (None, None, None, "b"), (None, "f", 0, "c")],
                                  "job_id string, file_path string, chunk_index int, summary string")
    assert sorted((r.ordinal, r.bullet) for r in CH.project_bullets(nulls).collect()) == [(1, "a"), (2, "b"), (3, "c")]


def test_several_replies_of_a_job_make_one_report(spark):
    replies = spark.createDataFrame([
        ("j", 1, '{"executiveSummary": "a", "architecturalAssessment": "same", "topRecommendations": ["z"]}'),
        ("j", 0, '{"executiveSummary": "b", "architecturalAssessment": "same", "topRecommendations": ["y", "y"]}')],
        "job_id string, part int, reply string")
    requests = spark.createDataFrame([("j", "P", True)], "job_id string, project_name string, include_llm boolean")
    requests = requests.withColumn("started_at", F.lit("2024-01-01").cast("timestamp_ntz"))
    files = spark.createDataFrame([("j", "f", "x")], "job_id string, path string, content string")
    rows = RP.build_reports(requests, files, _findings(spark, 1, "t"), R.parse_project_replies(replies)).collect()
    assert [(r.executive_summary, r.architectural_assessment, r.top_recommendations) for r in rows] == [("b\n\na", "same", ["y", "y", "z"])]


@pytest.fixture(scope="module")
def one_method_each(spark, tmp_path_factory):
    """Tables of five Java files, one snippet and one project each: the project's number is the snippet's. Project 23 has a
    model reply with one HIGH finding."""
    at = {}
    for key in range(3, 20_000, 3):
        java = EXTENSIONS[key % len(EXTENSIONS)] == ".java" and DIRECTORIES[key % len(DIRECTORIES)] == "lib/core"
        if java and key % BIG_EVERY != BIG_AT:
            at.setdefault((key * 7 + key // 32) % N, key)
    folder = str(tmp_path_factory.mktemp("tables"))
    kept = (17, 23, 24, 25, 30)
    tables = {
        "orders": ([(at[n], n) for n in kept], "o_orderkey bigint, o_custkey bigint"),
        "customer": ([(n, f"C{n}") for n in kept], "c_custkey bigint, c_name string"),
        "events": ([(8, 23)], "event_id bigint, user_id bigint"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return folder


METHODS = {23: {("QA-PARAMS-001", "LOW", 7)}, 24: {("QA-COMPLEXITY-001", "MEDIUM", 7), ("QA-NESTING-001", "LOW", 7)},
           25: {("QA-LONG-METHOD-001", "MEDIUM", 7)}}
NOTES = {17: {("QA-TODO-001", "INFO", n) for n in (7, 8)}}


def test_all_findings_have_the_method_metrics(spark, one_method_each):
    got = {}
    for r in QUERIES["all_findings"](spark, one_method_each).collect():
        got.setdefault(int(r.job_id[4:]), set()).add((r.rule_id, r.severity, r.line_number))
    assert got == METHODS | NOTES


def test_reports_count_and_list_the_method_metrics(spark, one_method_each):
    counts = {int(r.job_id[4:]): (r.total_findings, r.high_count, r.medium_count, r.low_count, r.info_count)
              for r in QUERIES["report"](spark, one_method_each).collect()}
    assert counts == {17: (2, 0, 0, 0, 2), 23: (2, 1, 0, 1, 0), 24: (2, 0, 1, 1, 0), 25: (1, 0, 1, 0, 0), 30: (0, 0, 0, 0, 0)}
    listed = {int(r.job_id[4:]): (r.total_findings, r.listed) for r in QUERIES["report_json"](spark, one_method_each).collect()}
    assert listed == {17: (2, 2), 23: (2, 2), 24: (2, 2), 25: (1, 1), 30: (0, 0)}
