"""The scans: security rules, quality rules with metrics, and both in one pass over the texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import paths as P
from ..functions.text import line_count
from ..operators import findings as FN
from ..operators.matching import hit_lists, match_rules
from ..operators.methods import DEFAULT_LIMITS, method_measures
from ..operators.rule_catalog import METRIC_RULES, Rule, quality_rules, rules_from_frame, security_rules


def scan_scope(files: DataFrame, excluded_names=()) -> DataFrame:
    """Files the security scan looks at, paths normalised."""
    return files.where(P.in_scan_scope("path", "content", excluded_names)).withColumn("path", P.normalize_path("path"))


def _any_break(profile: str) -> tuple[str, ...]:
    """Views whose lines end at any line break: taken literally, the security rules number their lines so."""
    return ("masked",) if profile == "as_coded" else ()


def security_hits(files: DataFrame, rules=None, profile: str = "documented", paths_unique: bool = False) -> DataFrame:
    """(job_id, path, rule_id, line_number). Hits are distinct within a text already; the closing dedupe is for
    paths that become equal when normalised and can be left out where that cannot happen (it must be on a stream).

    The path part of the scope is a filter, ahead of everything; whether the text is blank is a flag computed with the
    views, so that the text goes through one projection only.
    """
    scoped = files.where(P.path_in_scope("path")).withColumn("path", P.normalize_path("path"))
    hits = match_rules(scoped, rules or security_rules(profile), in_scope=~P.is_blank("content"), any_break=_any_break(profile))
    hits = hits.drop("subject", "measured")
    return hits if paths_unique else FN.dedupe_findings(hits, FN.HIT_KEY)


def security_scan(files: DataFrame, rules=None, profile: str = "documented", paths_unique: bool = False) -> DataFrame:
    rules = rules or security_rules(profile)
    return FN.enrich_findings(security_hits(files, rules, profile, paths_unique), rules)


def quality_hits(files: DataFrame, rules=None, profile: str = "documented") -> DataFrame:
    """Hits of the regex rules on the raw lines: all languages, test files too, no dedupe."""
    hits = match_rules(files.where(F.col("content").isNotNull()), rules or quality_rules(profile))
    return hits.drop("subject", "measured")


def quality_scan(files: DataFrame, rules=None, profile: str = "documented", limits: dict | None = None) -> DataFrame:
    """Regex rules, method metrics of ``.java`` files and the file metric, in one pass."""
    rules = rules or quality_rules(profile)
    limits = {**DEFAULT_LIMITS, **(limits or {})}
    hits = match_rules(files.where(F.col("content").isNotNull()), rules, limits=limits)
    return FN.enrich_findings(hits, rules + METRIC_RULES, limits)


def method_findings(facts: DataFrame, limits: dict | None = None) -> DataFrame:
    """Findings of the four method metrics over an existing table of method facts."""
    return FN.enrich_findings(method_measures(facts, limits), METRIC_RULES, limits)


def large_files(files: DataFrame, limit: int = C.MAX_FILE_LINES) -> DataFrame:
    """Findings of the file metric alone: lines are counted, nothing is masked or cut into tokens."""
    rule = "QA-GOD-CLASS-001"
    hits = files.where(F.col("content").isNotNull()).select(
        "job_id", "path", F.lit(rule).alias("rule_id"), F.lit(1).alias("line_number"),
        F.col("path").alias("subject"), line_count("content").alias("measured"),
    )
    return FN.enrich_findings(hits.where(F.col("measured") > limit), METRIC_RULES, {rule: limit})


def _rule_set(rules, profile: str) -> tuple[Rule, ...]:
    """The built-in rules of a profile, or the caller's own: a sequence of rules or a rule table."""
    if rules is None:
        return security_rules(profile) + quality_rules(profile)
    return rules_from_frame(rules) if isinstance(rules, DataFrame) else tuple(rules)


def _one_pass(files: DataFrame, matcher, rules: tuple[Rule, ...], limits: dict | None, metrics: bool, profile: str) -> DataFrame:
    return matcher(
        files.where(F.col("content").isNotNull()), rules,
        in_scope=P.in_scan_scope("path", "content"), limits={**DEFAULT_LIMITS, **(limits or {})} if metrics else None,
        any_break=_any_break(profile),
    )


def _to_findings(hits: DataFrame, rules: tuple[Rule, ...], limits: dict | None, paths_unique: bool) -> DataFrame:
    """Security findings are distinct per (rule, file, line), their paths normalised; the others are given as often as
    they came."""
    is_security = F.col("rule_id").isin([r.rule_id for r in rules if r.category == "SECURITY"])
    hits = hits.withColumn("path", F.when(is_security, P.normalize_path("path")).otherwise(F.col("path")))
    if not paths_unique:
        columns = hits.columns
        copies = F.sequence(F.lit(1), F.when(is_security, 1).otherwise(F.col("n")))
        hits = hits.groupBy(*columns).agg(F.count("*").alias("n")).select(*columns, F.explode(copies).alias("_copy")).drop("_copy")
    given = {r.rule_id for r in rules}
    return FN.enrich_findings(hits, (*rules, *[r for r in METRIC_RULES if r.rule_id not in given]), limits)


def file_scans(
    files: DataFrame, profile: str = "documented", limits: dict | None = None, rules=None, metrics: bool = True
) -> DataFrame:
    """One small row per file: (job_id, path, lines, hits), from a single pass over the texts with all rules.

    Findings and file statistics both come out of this table. Written once, it spares every later step the texts.
    ``rules``, a sequence of rules or a rule table, takes the place of the built-in ones; ``metrics`` can be left out.
    """
    return _one_pass(files, hit_lists, _rule_set(rules, profile), limits, metrics, profile)


def findings_of(scans: DataFrame, limits: dict | None = None, paths_unique: bool = False, rules=None) -> DataFrame:
    """Findings of a written table of file scans; ``rules`` are those it was made with."""
    hits = scans.select("job_id", "path", F.inline("hits"))
    return _to_findings(hits, _rule_set(rules, "documented"), limits, paths_unique)


def all_findings(
    files: DataFrame, reply_findings: DataFrame | None = None, profile: str = "documented",
    limits: dict | None = None, paths_unique: bool = False, rules=None, metrics: bool = True,
) -> DataFrame:
    """Security, quality and metric findings of every file, each text read and masked once, plus the findings taken
    from model replies if there are any. ``rules`` and ``metrics`` as in ``file_scans``."""
    chosen = _rule_set(rules, profile)
    out = _to_findings(_one_pass(files, match_rules, chosen, limits, metrics, profile), chosen, limits, paths_unique)
    return out if reply_findings is None else out.unionByName(reply_findings)
