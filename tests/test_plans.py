"""The plans behind the scans: one read, one mask, no shuffle of texts, no cross join."""

import re

from pyspark.sql import functions as F

from sieveline.operators import chunks as CH
from sieveline.operators import metrics as MR
from sieveline.operators.findings import HIT_KEY, dedupe_findings, merge_passes, merge_tagged
from sieveline.operators.matching import both_passes, line_pass, match_rules, text_pass
from sieveline.operators.methods import method_facts
from sieveline.operators.rule_catalog import QUALITY_RULES, SECURITY_RULES
from sieveline.plans import scan

LEXER = r"(?s:.*?)(?:\*/|\z)"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def optimized(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def stored(spark, tmp_path):
    from fixtures.source_tables import source_files

    path = str(tmp_path / "files")
    source_files(spark, "/root/testdata/sf0.001").withColumn("unused", F.lit("x")).write.parquet(path)
    return spark.read.parquet(path)


def stored_again(tmp_path, spark):
    return spark.read.parquet(str(tmp_path / "files"))


def test_map_only_operators_do_not_shuffle(spark, tmp_path):
    files = stored(spark, tmp_path)
    for frame in (
        match_rules(files, SECURITY_RULES + QUALITY_RULES), scan.file_scans(files), method_facts(files), MR.file_metrics(files),
        MR.line_classes(files), CH.chunk_text(files), scan.security_scan(files, paths_unique=True),
    ):
        text = plan(frame)
        assert "Exchange hashpartitioning" not in text and "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
        assert "unused" not in text


def test_text_is_masked_once_and_never_shuffled(spark, tmp_path):
    files = stored(spark, tmp_path)
    for frame in (scan.security_scan(files), scan.all_findings(files), scan.quality_scan(files), scan.file_scans(files)):
        assert optimized(frame).count(LEXER) == 1
        assert plan(frame).count("FileScan parquet") == 1
        for exchange in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(frame)):
            assert "content" not in exchange


def test_both_passes_come_from_one_scan(spark, tmp_path):
    files = scan.scan_scope(stored(spark, tmp_path))
    hits = both_passes(files, SECURITY_RULES)
    for frame in (merge_tagged(hits), dedupe_findings(hits, HIT_KEY)):
        assert optimized(frame).count(LEXER) == 1 and plan(frame).count("FileScan parquet") == 1
        assert plan(frame).count("Exchange") == 1 and "Join" not in plan(frame)
    merged = merge_passes(line_pass(files, SECURITY_RULES), text_pass(files, SECURITY_RULES)).select(*HIT_KEY)
    assert merged.exceptAll(merge_tagged(hits).select(*HIT_KEY)).count() == 0 == merge_tagged(hits).select(*HIT_KEY).exceptAll(merged).count()


def test_path_scope_is_filtered_at_the_scan_and_rules_are_broadcast(spark, tmp_path):
    text = plan(scan.security_scan(stored(spark, tmp_path)))
    assert "unused" not in text
    # bottom-up: the relation, then the filter on the path, before anything is computed from the text
    steps = [line for line in optimized(scan.security_scan(stored_again(tmp_path, spark))).splitlines() if re.match(r"[\s:+\-|]*[A-Z]", line)]
    at = next(i for i, line in enumerate(steps) if "Relation [" in line)
    assert "Filter" in steps[at - 1] and "/test/" in steps[at - 1] and "content" not in steps[at - 1]
    # the rule table is the broadcast side, never the findings
    assert "BroadcastHashJoin" in text and "BuildRight" in text and "SortMergeJoin" not in text


def test_hot_project_gives_the_same_findings(spark):
    """All files in one project: same findings as spread over many."""
    from fixtures.source_tables import source_files

    spread = source_files(spark, "/root/testdata/sf0.001")
    hot = spread.withColumn("job_id", F.lit("hot"))
    a = scan.all_findings(spread).drop("job_id")
    b = scan.all_findings(hot).drop("job_id")
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0
