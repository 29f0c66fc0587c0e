"""Operators over hits and findings: merge, dedupe, attach rule texts, count, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from .methods import DEFAULT_LIMITS
from .rule_catalog import CATALOG, Rule, rules_frame, rules_from_frame

HIT_KEY = ("job_id", "rule_id", "path", "line_number")
FINDING_COLUMNS = (
    "job_id", "severity", "category", "title", "description", "recommendation",
    "file_path", "line_number", "rule_id", "source",
)


def merge_passes(line_hits: DataFrame, text_hits: DataFrame, key=HIT_KEY) -> DataFrame:
    """All line hits, plus the whole-text hits on lines where the same rule has not hit already."""
    fresh = text_hits.join(line_hits.select(*key).distinct(), list(key), "left_anti")
    return line_hits.unionByName(fresh)


def merge_tagged(hits: DataFrame, key=HIT_KEY) -> DataFrame:
    """What ``merge_passes`` gives, from the hits of ``both_passes``: each place of a rule once, with ``found_by`` the line pass where
    that has hit there. The anti join is an aggregate on the tag, so the texts are scanned once and only small rows move."""
    return hits.groupBy(*key).agg(F.min("found_by").alias("found_by"))  # line comes before text


def dedupe_findings(findings: DataFrame, key=("job_id", "rule_id", "file_path", "line_number")) -> DataFrame:
    """One row per (job, rule, file, line). Rows with equal keys are equal; nulls count as equal."""
    return findings.dropDuplicates(list(key))


def severity_rank(severity) -> Column:
    ranks = F.create_map(*[F.lit(x) for i, s in enumerate(C.SEVERITIES) for x in (s, i)])
    return F.try_element_at(ranks, F.col(severity) if isinstance(severity, str) else severity)


def enrich_findings(
    hits: DataFrame, rules: tuple[Rule, ...] | DataFrame = CATALOG, limits: dict[str, int] | None = None
) -> DataFrame:
    """Attach rule texts to hits (job_id, path, line_number, rule_id and, for metric rules, subject, measured).

    The rule table is configuration: its size is checked (``MAX_RULES``), so it is broadcast. The few dozen rule ids
    would make hopelessly skewed keys for any other join.
    """
    if isinstance(rules, DataFrame):
        rules = rules_from_frame(rules)
    rules = rules_frame(hits.sparkSession, rules)
    limits = {**DEFAULT_LIMITS, **(limits or {})}
    limit_of = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    texts = rules.select(
        "rule_id", "title", "description", "recommendation", "severity", "category", "source",
        F.try_element_at(limit_of, F.col("rule_id")).alias("_limit"),
    )
    for name in ("subject", "measured"):
        if name not in hits.columns:
            hits = hits.withColumn(name, F.lit(None).cast("string"))

    def filled(text: str) -> Column:
        out = F.replace(F.col(text), F.lit("{subject}"), F.col("subject"))
        out = F.replace(out, F.lit("{measured}"), F.col("measured").cast("string"))
        out = F.replace(out, F.lit("{limit}"), F.col("_limit").cast("string"))
        return F.coalesce(out, F.col(text))

    severe = (F.col("rule_id") == "QA-COMPLEXITY-001") & (F.col("measured").cast("int") > C.SEVERE_COMPLEXITY)
    return hits.withColumnRenamed("path", "file_path").join(F.broadcast(texts), "rule_id").withColumns({
        "title": filled("title"),
        "description": filled("description"),
        "severity": F.when(severe, "HIGH").otherwise(F.col("severity")),
    }).select(*FINDING_COLUMNS)


def severity_counts(findings: DataFrame, by=("job_id",), rollup: bool = False) -> DataFrame:
    """Total and one count per severity, absent ones zero. Partial counts leave each task, so a huge job is no
    hot spot. ``rollup`` adds sub-totals."""
    grouped = findings.rollup(*by) if rollup else findings.groupBy(*by)
    return grouped.agg(
        F.count("*").alias("total"),
        *[F.count_if(F.col("severity") == s).alias(s.lower()) for s in C.SEVERITIES],
    )


def owasp_rollup(findings: DataFrame) -> DataFrame:
    """Findings per OWASP 2021 category. Aggregated first, named after."""
    names = F.create_map(*[F.lit(x) for kv in C.OWASP_2021.items() for x in kv])
    code = F.regexp_extract("rule_id", r"\AOWASP-(A\d\d)", 1)
    return (
        findings.where(F.col("rule_id").startswith("OWASP-"))
        .groupBy(code.alias("owasp_code"))
        .agg(F.count("*").alias("findings"))
        .withColumn("owasp_category", F.try_element_at(names, F.col("owasp_code")))
        .where(F.col("owasp_category").isNotNull())
        .select("owasp_category", "findings")
    )


def ordered_findings(findings: DataFrame) -> DataFrame:
    """Worst first, then path, rule and line. A full sort, on request only."""
    return findings.orderBy(severity_rank("severity"), "job_id", "file_path", "rule_id", "line_number")


def top_findings(findings: DataFrame, k: int) -> DataFrame:
    """The k worst findings; each task keeps k rows, no full sort."""
    return ordered_findings(findings).limit(k)
