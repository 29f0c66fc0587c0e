"""Rule matching over a table of texts.

Everything up to the list of (rule, line) pairs of a text happens inside one row, so matching never shuffles, adds
no state to a stream, and a project holding a third of all files costs no more than the same files spread out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.cleaning import normalize_line_endings
from ..functions.reuse import built_once
from .methods import DEFAULT_LIMITS, may_have_methods, may_pass_a_limit, measure_array, method_array
from .rule_catalog import Rule

KEYS = ("job_id", "path")
HITS = "array<struct<rule_id:string,line_number:int,subject:string,measured:int>>"
_NO_LINES = "array<int>"
_BLANKS = set(" \t\n\r\x0b\f")


def explode_lines(files: DataFrame, content: str = "content", keys=KEYS, breaks: str = "any") -> DataFrame:
    """One row per line: ``line_number`` from 1, trailing blank lines kept. No sort and no shuffle. Lines end at any line break, or
    with ``breaks="newline"`` at line feeds only, carriage returns being turned into those."""
    if breaks not in ("any", "newline"):
        raise ValueError(f"unknown breaks: {breaks}")
    lines = T.split_any_lines(content) if breaks == "any" else T.split_lines(normalize_line_endings(content))
    return files.select(*keys, F.posexplode(lines).alias("pos", "line")).select(
        *keys, (F.col("pos") + 1).alias("line_number"), "line"
    )


def source_views(files: DataFrame, views, needed: dict[str, Column] | None = None) -> DataFrame:
    """Add the wanted views of ``content``: ``v_raw``, ``v_no_comments``, ``v_masked``. Of the latter two those in ``needed`` are made
    only where its condition holds, and are null elsewhere."""
    views, needed = set(views), needed or {}
    base = files.withColumn("v_raw", F.replace("content", F.lit(T.MARK), F.lit(" ")))
    made = {"no_comments": T.without_comments, "masked": T.without_literals}
    wanted = [v for v in made if v in views]
    if wanted:
        text = normalize_line_endings("v_raw")
        if all(v in needed for v in wanted):
            text = F.when(reduce(lambda a, b: a | b, [needed[v] for v in wanted]), text)
        base = base.withColumn("_pieces", T.code_pieces(text))
        for v in wanted:
            view = made[v]("_pieces")
            base = base.withColumn(f"v_{v}", F.when(needed[v], view) if v in needed else view)
    return base


def _probe(rule: Rule, low: Column) -> Column:
    return reduce(lambda a, b: a | b, [low.contains(p) for p in rule.probes])


def _possible(rule: Rule) -> Column:
    """Whether the raw text can hold a match. The other views are the raw text with characters blanked, so that a probe without blanks
    is in none of them where the raw text has it not: a text that no rule of a view can match needs no such view."""
    if not rule.probes or rule.view != "raw" and any(not p.isascii() or set(p) & _BLANKS for p in rule.probes):
        return F.lit(True)
    return _probe(rule, F.col("low_raw"))


@built_once
def _rule_lines(rule: Rule, at: int) -> Column:
    """Distinct line numbers of one rule, the one at ``at`` of those staged, in one text; texts without a probe word skip the regex."""
    parts = []
    pattern = f"(?=[{rule.starts}])(?:{rule.pattern})" if rule.starts else rule.pattern
    if rule.scope in ("line", "both"):
        parts.append(T.line_hits(f"lines_{rule.view}", pattern, rule.probes))
    if rule.scope in ("text", "both"):
        parts.append(T.match_start_lines(f"v_{rule.view}", pattern))
    lines = parts[0] if len(parts) == 1 else F.array_distinct(F.concat(*parts))
    tried = F.col("_tried")[at]
    if rule.probes and rule.view != "raw":
        tried &= _probe(rule, F.lower(f"v_{rule.view}"))
    return F.when(tried, lines).otherwise(F.array().cast(_NO_LINES))


def _any(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags, F.lit(False))


def _staged(files: DataFrame, rules, keys, in_scope, limits: dict[str, int] | None = None, any_break=(), all_scoped: bool = False):
    """What the rules look at, each computed once per text: ``_tried``, a flag for each rule, set where the text may hold a match, and
    the views and their lines, where a rule that is tried looks at them. ``in_scope`` says which texts the rules of category SECURITY
    are tried on, or with ``all_scoped`` all rules. With ``limits``, the method facts of ``.java`` texts that may pass one, too, which
    are read before the lines are there, so that few columns wait for them. The lines of the views in ``any_break`` end at any line
    break, those of the others at line feeds."""
    rules = [r for r in rules if r.pattern]
    flags = [F.col("_tried")[i] for i in range(len(rules))]
    split = lambda v: T.split_any_lines if v in any_break else T.split_lines
    scope = F.lit(True) if in_scope is None else in_scope
    base = files.select(*keys, "content", scope.alias("_scope"), F.replace("content", F.lit(T.MARK), F.lit(" ")).alias("_text"))
    low = base.select("*", F.lower("_text").alias("low_raw"))

    def tried(rule: Rule) -> Column:
        at_all = F.col("_scope") if all_scoped or rule.category == "SECURITY" else F.lit(True)
        return F.coalesce(at_all & F.col("content").isNotNull() & _possible(rule), F.lit(False))

    text = normalize_line_endings("_text")
    java = F.col("path").endswith(".java") & may_have_methods(F.col("_text")) & may_pass_a_limit(text, limits) if limits else F.lit(False)
    flagged = low.select(*keys, "content", F.array(*[tried(r) for r in rules]).alias("_tried"), java.alias("_java"))
    needed = {v: _any([f for f, r in zip(flags, rules) if r.view == v]) for v in ("no_comments", "masked")}
    views = {r.view for r in rules}
    if limits:
        views, needed["masked"] = views | {"masked"}, needed["masked"] | F.col("_java")
    viewed = source_views(flagged, views, needed).drop("_pieces")
    if limits:
        java = F.col("_java") & may_have_methods(F.col("v_masked"))
        viewed = viewed.withColumn("_facts", method_array(F.when(java, F.col("v_masked")), False))
        viewed = viewed.withColumn("_lines", T.line_count("content"))
    line_flags = {}
    for flag, r in zip(flags, rules):
        if r.scope in ("line", "both"):
            line_flags.setdefault(r.view, []).append(flag)
    return rules, viewed.select("*", *[F.when(_any(line_flags[v]), split(v)(f"v_{v}")).alias(f"lines_{v}") for v in sorted(line_flags)])


def _measures(limits: dict[str, int]) -> Column:
    """Hits of the metric rules: methods over a limit (``.java`` only) and texts over the line limit."""
    lines = F.col("_lines")
    large = F.when(lines > limits["QA-GOD-CLASS-001"], F.array(F.struct(
        F.lit("QA-GOD-CLASS-001").alias("rule_id"), F.lit(1).alias("line_number"),
        F.col("path").alias("subject"), lines.alias("measured"),
    )))
    return F.concat(
        F.coalesce(measure_array(F.col("_facts"), limits), F.array().cast(HITS)),
        F.coalesce(large, F.array().cast(HITS)),
    )


def _hits(files: DataFrame, rules, keys, in_scope, limits, any_break=()) -> tuple[DataFrame, Column]:
    """The staged texts and the array of (rule_id, line_number, subject, measured) to compute from each."""
    limits = {**DEFAULT_LIMITS, **limits} if limits else None
    rules, staged = _staged(files, rules, keys, in_scope, limits, any_break)

    def tagged(rule: Rule, at: int) -> Column:
        return F.transform(_rule_lines(rule, at), lambda n: F.struct(
            F.lit(rule.rule_id).alias("rule_id"), n.alias("line_number"),
            F.lit(None).cast("string").alias("subject"), F.lit(None).cast("int").alias("measured"),
        ))

    hits = [tagged(r, i) for i, r in enumerate(rules)]
    if limits:
        hits.append(_measures(limits))
    return staged, F.concat(*hits)


def hit_lists(
    files: DataFrame, rules, keys=KEYS, in_scope: Column | None = None, limits: dict[str, int] | None = None, any_break=(),
) -> DataFrame:
    """One row per text: keys, its line count, and ``hits``, an array of (rule_id, line_number, subject, measured).
    Meant to be written as a table: a plan that goes on to explode ``hits`` should use ``match_rules``."""
    staged, hits = _hits(files, rules, keys, in_scope, limits, any_break)
    return staged.select(*keys, (F.col("_lines") if limits else T.line_count("content")).alias("lines"), hits.alias("hits"))


def match_rules(
    files: DataFrame, rules, keys=KEYS, in_scope: Column | None = None, limits: dict[str, int] | None = None, any_break=(),
) -> DataFrame:
    """(keys, rule_id, line_number, subject, measured), one row per rule and line, all rules in one pass over the
    texts. ``in_scope`` limits the rules of category SECURITY to some of the texts. With ``limits`` the metric rules
    are evaluated in the same pass; only their hits carry ``subject`` and ``measured``. Lines of the views in ``any_break`` end at any
    line break."""
    staged, hits = _hits(files, rules, keys, in_scope, limits, any_break)
    # The array goes into the generator as an expression. As a column of its own it would make the optimizer infer a
    # filter on its size and push that below the staging, computing every view and every rule several times.
    return staged.select(*keys, F.inline(hits))


def _single_scope(rules, scope: str):
    wanted = {"line": ("line", "both"), "text": ("text", "both")}[scope]
    return [Rule(**{**r.__dict__, "scope": scope}) for r in rules if r.scope in wanted]


def line_pass(files: DataFrame, rules, keys=KEYS, in_scope: Column | None = None, any_break=()) -> DataFrame:
    """The line part of the rules only."""
    return match_rules(files, _single_scope(rules, "line"), keys, in_scope, any_break=any_break)


def text_pass(files: DataFrame, rules, keys=KEYS, in_scope: Column | None = None) -> DataFrame:
    """The whole-text part of the rules only."""
    return match_rules(files, _single_scope(rules, "text"), keys, in_scope)


def both_passes(files: DataFrame, rules, keys=KEYS, in_scope: Column | None = None) -> DataFrame:
    """(keys, rule_id, line_number, found_by): the hits of the line part (``line``) and of the whole-text part (``text``) of the rules,
    told apart by a tag. The texts are read and masked once for both."""
    single = [(r, scope) for scope in ("line", "text") for r in _single_scope(rules, scope)]
    single = [(r, scope) for r, scope in single if r.pattern]
    _, staged = _staged(files, [r for r, _ in single], keys, in_scope, all_scoped=True)
    return staged.select(*keys, F.inline(F.concat(*[_tagged(r, i, scope) for i, (r, scope) in enumerate(single)])))


def _tagged(rule: Rule, at: int, scope: str) -> Column:
    return F.transform(_rule_lines(rule, at), lambda n: F.struct(
        F.lit(rule.rule_id).alias("rule_id"), n.alias("line_number"), F.lit(scope).alias("found_by")))


def rule_hit_counts(files: DataFrame, rules, rule_table: DataFrame, keys=KEYS, in_scope=None) -> DataFrame:
    """Hits and files per rule, silent rules included with zero. The rule x file x line loop stays inside the rows;
    only one small row per rule and partition is shuffled."""
    rules, staged = _staged(files, rules, keys, in_scope)

    def counted(rule: Rule, at: int) -> Column:
        return F.struct(F.lit(rule.rule_id).alias("rule_id"), F.size(_rule_lines(rule, at)).alias("n"))

    counts = (
        staged.select(F.inline(F.array(*[counted(r, i) for i, r in enumerate(rules)])))
        .groupBy("rule_id")
        .agg(F.sum("n").alias("hits"), F.count_if(F.col("n") > 0).alias("files"))
    )
    return rule_table.select("rule_id").join(counts, "rule_id", "left").select(
        "rule_id", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("hits", "files")]
    )
