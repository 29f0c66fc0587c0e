"""Rules look only at the texts that may hold a match, and the reader of tokens only at those in which a method may pass a limit."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from sieveline.operators.matching import _staged, both_passes, match_rules, source_views
from sieveline.operators.methods import DEFAULT_LIMITS, method_facts, method_measures
from sieveline.operators.rule_catalog import QUALITY_RULES, SECURITY_RULES, Rule
from sieveline.plans import scan

SMALL = "class A {\n    int add(int a, int b) {\n        return a + b;\n    }\n}\n"
OVER = {
    "QA-LONG-METHOD-001": "class A {\n  void m() {\n" + "    go();\n" * 55 + "  }\n}\n",
    "QA-PARAMS-001": "class A { void m(int a, int b, int c, int d, int e, int f) { } }",
    "QA-COMPLEXITY-001": "class A { int m(int n) { return " + "n > 1 ? 2 : " * 10 + "3; } }",
    "QA-NESTING-001": "class A { void m() { if (a) x(); else if (b) y(); else if (c) z(); else if (d) { while (e) { } } } }",
}


def staged(table, rules, limits=None):
    return _staged(table, rules, ("job_id", "path"), None, limits)[1]


def test_only_texts_that_may_pass_a_limit_are_read_as_tokens(files):
    table = files({"small.java": SMALL, "over.py": OVER["QA-PARAMS-001"], **{f"{rule}.java": text for rule, text in OVER.items()}})
    read = {r.path for r in staged(table, QUALITY_RULES, DEFAULT_LIMITS).where("_java").collect()}
    assert read == {f"{rule}.java" for rule in OVER}
    metrics = scan.all_findings(table).where(F.col("source") == "JAVAPARSER_AST")
    found = {(r.file_path, r.rule_id) for r in metrics.collect()}
    assert found == {(r.path, r.rule_id) for r in method_measures(method_facts(table)).collect()}
    assert {(f"{rule}.java", rule) for rule in OVER} <= found


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_the_bound_counts_all_line_ends(files, end):
    table = files({"Long.java": OVER["QA-LONG-METHOD-001"].replace("\n", end)})
    assert [r.rule_id for r in scan.all_findings(table).collect()] == ["QA-LONG-METHOD-001"]


def test_views_are_made_only_where_a_rule_may_match(files):
    table = files({"plain.py": "a = 1  # b\n" * 3, "dice.py": "r = new Random(); // x\n", "raw.py": "// TODO new\n"})
    rows = {r.path: r for r in staged(table, [r for r in SECURITY_RULES if r.view == "masked"] + list(QUALITY_RULES)).collect()}
    assert rows["plain.py"].v_masked is None and rows["plain.py"].lines_masked is None and rows["plain.py"].lines_raw is None
    assert rows["dice.py"].v_masked == "r = new Random();     \n" and rows["dice.py"].lines_masked == ["r = new Random();     ", ""]
    assert rows["raw.py"].v_masked is None and rows["raw.py"].lines_raw == ["// TODO new", ""]
    assert source_views(table, {"masked"}).where("v_masked IS NULL").count() == 0


def test_a_probe_with_blanks_may_come_from_blanked_comments(files):
    rule = Rule("X", "LOW", "a  +b", probes=("a     b",), scope="both")
    assert [r.line_number for r in match_rules(files({"x.c": "\na/***/b\n"}), [rule]).collect()] == [2]


def test_starts_change_nothing_that_is_found(spark):
    from fixtures.source_tables import source_files

    texts = source_files(spark, "/root/testdata/sf0.001").limit(400)
    upper = texts.withColumn("content", F.upper("content")).withColumn("path", F.concat(F.lit("U"), "path"))
    table = texts.unionByName(upper)
    assert sum(bool(r.starts) for r in SECURITY_RULES) > 5
    # an id of its own, as expressions are kept by rule
    plain = [replace(r, rule_id=f"plain {r.rule_id}", starts="") for r in SECURITY_RULES]
    with_starts = both_passes(table, SECURITY_RULES)
    without = both_passes(table, plain).withColumn("rule_id", F.substring("rule_id", 7, 99))
    assert with_starts.count() > 100
    assert with_starts.exceptAll(without).count() == 0 == without.exceptAll(with_starts).count()
