"""JSON whose objects repeat keys, and lines by every kind of break."""

import pytest
from pyspark.sql import functions as F

from sieveline.functions import checks as K
from sieveline.functions import json_values as J
from sieveline.operators import replies as R
from sieveline.operators.matching import explode_lines
from sieveline.plans import scan

VALID = ['{"a":1,"a":2}', '{"a":{"b":1,"b":2}}', '[{"a":1,"a":1}]', "{}", "[]", "1", "true", "null", '"x"', ' {"a": [1, 2]} ', '{"a":1,"a":2} rest', '[1, [2, {"k": "]"}]]']
INVALID = ["{'a':1,'a':2}", '{"a":1,"a":}', '{"a":1,"a":2', "[1", "x", "{a:1}", '{"a" 1}', "", "  ", None, '{"a":NaN,"a":1}']


def test_validity_does_not_depend_on_repeated_keys(spark):
    rows = spark.createDataFrame([(t,) for t in VALID + INVALID], "t string").select("t", K.is_valid_json("t").alias("ok"), J.is_json("t").alias("json")).collect()
    assert {r.t for r in rows if r.ok} == set(VALID)
    assert all(r.ok == bool(r.json) for r in rows)


def test_the_last_value_of_a_key_counts(spark):
    rows = spark.createDataFrame([('{"a":1,"b":"x","a":2}',), ("no",)], "t string").select(J.parse_rows("t", "a int, b string").alias("r")).collect()
    assert rows[0].r == (2, "x") and rows[1].r is None
    reply = '```json {"summary": "one", "findings": [{"title": "a", "title": "b", "lineHint": 3}], "summary": "two"}```'
    given = spark.createDataFrame([("j", "f", 0, "beta", reply)], "job_id string, file_path string, chunk_index int, provider string, reply string")
    parsed = R.parse_chunk_replies(given)
    assert parsed.first().summary == "two"
    assert [(r.title, r.severity, r.line_number) for r in R.reply_findings(parsed).collect()] == [("b", "INFO", 3)]
    project = spark.createDataFrame([("j", '{"executiveSummary":"a","executiveSummary":"b","topRecommendations":["x","y"]}')], "job_id string, reply string")
    row = R.parse_project_replies(project).first()
    assert (row.executive_summary, row.top_recommendations) == ("b", ["x", "y"])


@pytest.mark.parametrize("mark", ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x85", " ", " "])
def test_every_break_ends_a_line(files, mark):
    table = files({"a.java": f"one{mark}{mark}three{mark}"})
    rows = sorted((r.line_number, r.line) for r in explode_lines(table).collect())
    assert rows == [(1, "one"), (2, ""), (3, "three"), (4, "")]
    newline = {r.line_number for r in explode_lines(table, breaks="newline").collect()}
    assert newline == ({1, 2, 3, 4} if mark in ("\n", "\r", "\r\n") else {1})


@pytest.mark.parametrize("mark", ["\x0b", "\x0c", "\x85", " ", " "])
def test_rules_taken_literally_number_lines_by_every_break(files, mark):
    table = files({"a.java": f"int a;{mark}int b;{mark}int r = new Random();\nint c;"})
    hits = scan.security_hits(table, profile="as_coded").where("rule_id = 'OWASP-A02-RAND-001'")
    assert {r.line_number for r in hits.collect()} == {1, 3}  # the whole-text part counts line feeds
    documented = scan.security_hits(table).where("rule_id = 'OWASP-A02-RAND-001'")
    assert {r.line_number for r in documented.collect()} == {1}
    both = scan.all_findings(table, profile="as_coded").where(F.col("rule_id") == "OWASP-A02-RAND-001")
    assert {r.line_number for r in both.collect()} == {1, 3}
