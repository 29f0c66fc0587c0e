"""Queries of the scan operators over the derived source files."""

from __future__ import annotations

from pyspark.sql import functions as F

from sieveline.functions import constants as C
from sieveline.functions import paths as P
from sieveline.functions import text as T
from sieveline.operators import findings as FN
from sieveline.operators import matching as MT
from sieveline.operators import methods as ME
from sieveline.operators import metrics as MR
from sieveline.operators.rule_catalog import QUALITY_RULES, SECURITY_RULES, rules_frame
from sieveline.plans import scan as SC

from . import derived as D
from . import method_sql as M
from . import sql_parts as S
from .registry import query
from .source_tables import source_files, source_files_sql

HIT = "job_id, path, rule_id, line_number::BIGINT AS line_number"


def _hits(frame):
    return frame.select("job_id", "path", "rule_id", F.col("line_number").cast("bigint").alias("line_number"))


@query("findings_by_severity_and_language", S.with_ctes(*S.SECURITY_CTES, S.rule_table(), select=f"""
    SELECT {S.language()} AS language, severity, count(*) AS findings FROM security JOIN rules USING (rule_id) GROUP BY 1, 2"""))
def findings_by_severity_and_language(spark, sf):
    found = SC.security_scan(source_files(spark, sf))
    return found.groupBy(P.detect_language("file_path").alias("language"), "severity").agg(F.count("*").alias("findings"))


@query("security_line_pass", S.with_ctes(*S.SECURITY_CTES[:4], select=f"SELECT {HIT} FROM sec_line"))
def security_line_pass(spark, sf):
    return _hits(MT.line_pass(SC.scan_scope(source_files(spark, sf)), SECURITY_RULES))


@query("security_text_pass", S.with_ctes(*S.SECURITY_CTES[:3], S.SECURITY_CTES[4], select=f"SELECT {HIT} FROM sec_text"))
def security_text_pass(spark, sf):
    return _hits(MT.text_pass(SC.scan_scope(source_files(spark, sf)), SECURITY_RULES))


@query("merge_passes", S.with_ctes(*S.SECURITY_CTES, select=f"SELECT {HIT} FROM security"))
def merge_passes(spark, sf):
    return _hits(FN.merge_tagged(MT.both_passes(SC.scan_scope(source_files(spark, sf)), SECURITY_RULES)))


@query("found_by_pass", S.with_ctes(*S.SECURITY_CTES, select="""
    SELECT rule_id, CASE WHEN l.path IS NULL THEN 'text' ELSE 'line' END AS found_by, count(*) AS hits
    FROM security s LEFT JOIN (SELECT DISTINCT * FROM sec_line) l USING (job_id, path, rule_id, line_number) GROUP BY ALL"""))
def found_by_pass(spark, sf):
    merged = FN.merge_tagged(MT.both_passes(SC.scan_scope(source_files(spark, sf)), SECURITY_RULES))
    return merged.groupBy("rule_id", "found_by").agg(F.count("*").alias("hits"))


@query("dedupe_findings", S.with_ctes(*S.SECURITY_CTES, select=f"SELECT {HIT} FROM security"))
def dedupe_findings(spark, sf):
    both = MT.both_passes(SC.scan_scope(source_files(spark, sf)), SECURITY_RULES)
    return _hits(FN.dedupe_findings(both, FN.HIT_KEY))


FINDING = "job_id, severity, category, title, description, recommendation, path AS file_path, line_number::BIGINT AS line_number, rule_id, source"


def _findings(frame):
    return frame.withColumn("line_number", F.col("line_number").cast("bigint"))


@query("security_scan", S.with_ctes(*S.SECURITY_CTES, S.rule_table(), select=f"SELECT {FINDING} FROM security JOIN rules USING (rule_id)"))
def security_scan(spark, sf):
    return _findings(SC.security_scan(source_files(spark, sf)))


# with everything masked, the four rules about quoted text have nothing to find but the bare annotation
_AS_CODED = SC.security_rules("as_coded")
_NO_AUTH = [r for r in _AS_CODED if r.rule_id not in ("OWASP-A01-AUTH-001", "OWASP-A02-CRED-001")]


@query("security_scan_as_coded", S.with_ctes(*S.SECURITY_CTES[:3], select=f"""
    SELECT rule_id, count(*) AS hits FROM (
        {S.line_pass(_NO_AUTH)} UNION {S.text_pass(_NO_AUTH)}
        UNION SELECT job_id, path, 'OWASP-A01-AUTH-001', n FROM lines WHERE regexp_matches(v_masked,
            '(?i)@(GetMapping|PostMapping|PutMapping|DeleteMapping|RequestMapping)')) GROUP BY rule_id"""))
def security_scan_as_coded(spark, sf):
    hits = SC.security_hits(source_files(spark, sf), profile="as_coded")
    return hits.groupBy("rule_id").agg(F.count("*").alias("hits"))


@query("quality_line_pass", S.with_ctes(S.SRC, *S.QUALITY_CTES[:2], select=f"SELECT {HIT} FROM (" + S._renamed(S.line_pass(QUALITY_RULES)) + ")"))
def quality_line_pass(spark, sf):
    return _hits(MT.line_pass(source_files(spark, sf), QUALITY_RULES))


@query("quality_hits", S.with_ctes(S.SRC, *S.QUALITY_CTES, select=f"SELECT {HIT} FROM quality"))
def quality_hits(spark, sf):
    return _hits(SC.quality_hits(source_files(spark, sf)))


_QUALITY_HITS = """quality_all AS (
    SELECT job_id, path, rule_id, line_number, NULL AS subject, NULL::BIGINT AS measured, NULL::BIGINT AS lim FROM quality
    UNION ALL SELECT job_id, path, rule_id, line_number, path, measured, {} FROM large UNION ALL SELECT job_id, path, rule_id, line_number, subject, measured, lim FROM method_hits)""".format(C.MAX_FILE_LINES)
_QUALITY_ALL = (*S.QUALITY_CTES, S.LARGE_FILES, *M.METHOD_CTES, M.METHOD_HITS, _QUALITY_HITS)


@query("quality_scan", S.with_ctes(S.SRC, *_QUALITY_ALL, S.rule_table(), select=f"""
    SELECT job_id, {M.SEVERITY} AS severity, category, {M.filled('title')} AS title, {M.filled('description')} AS description, recommendation,
           path AS file_path, line_number::BIGINT AS line_number, rule_id, source FROM quality_all JOIN rules USING (rule_id)"""))
def quality_scan(spark, sf):
    return _findings(SC.quality_scan(source_files(spark, sf)))


@query("large_files", S.with_ctes(S.SRC, S.LARGE_FILES, S.rule_table(), select=f"""
    SELECT job_id, severity, title, replace(replace(replace(description, '{{subject}}', path), '{{measured}}', measured::VARCHAR),
           '{{limit}}', '{C.MAX_FILE_LINES}') AS description, path AS file_path, line_number::BIGINT AS line_number, rule_id
    FROM large JOIN rules USING (rule_id)"""))
def large_files(spark, sf):
    return _findings(SC.large_files(source_files(spark, sf))).select(
        "job_id", "severity", "title", "description", "file_path", "line_number", "rule_id")


@query("method_facts", S.with_ctes(S.SRC, *M.METHOD_CTES, select="""
    SELECT job_id, path, name, start_line, end_line, n_params, complexity, nesting FROM facts"""))
def method_facts(spark, sf):
    facts = ME.method_facts(source_files(spark, sf))
    return facts.select("job_id", "path", "name", *[
        F.col(c).cast("bigint").alias(c) for c in ("start_line", "end_line", "n_params", "complexity", "nesting")])


def _metric(rule: str, measure: str, limit: int) -> str:
    return f"""SELECT job_id, path, '{rule}' AS rule_id, start_line, name, {measure} AS measured, {limit} AS lim
               FROM facts WHERE {measure} > {limit}"""


@query("method_rules", S.with_ctes(f"facts AS ({D.FACTS_SQL})", S.rule_table(), "hits AS (" + " UNION ALL ".join([
    _metric("QA-LONG-METHOD-001", "(end_line - start_line)", C.MAX_METHOD_LENGTH),
    _metric("QA-PARAMS-001", "n_params", C.MAX_PARAMETERS),
    _metric("QA-COMPLEXITY-001", "complexity", C.MAX_COMPLEXITY),
    _metric("QA-NESTING-001", "nesting", C.MAX_NESTING)]) + ")", select=f"""
    SELECT job_id, CASE WHEN rule_id = 'QA-COMPLEXITY-001' AND measured > {C.SEVERE_COMPLEXITY} THEN 'HIGH' ELSE severity END AS severity,
           replace(title, '{{subject}}', name) AS title,
           replace(replace(replace(description, '{{subject}}', name), '{{measured}}', measured::VARCHAR), '{{limit}}', lim::VARCHAR) AS description,
           path AS file_path, start_line::BIGINT AS line_number, rule_id FROM hits JOIN rules USING (rule_id)"""))
def method_rules(spark, sf):
    return _findings(SC.method_findings(D.facts(spark, sf))).select(
        "job_id", "severity", "title", "description", "file_path", "line_number", "rule_id")


ALL_FINDINGS = (*S.SECURITY_CTES, *_QUALITY_ALL, S.rule_table(), f"""hits AS MATERIALIZED (
    SELECT job_id, path, rule_id, {M.SEVERITY} AS severity, category, source, {M.filled('title')} AS title, line_number::BIGINT AS line_number FROM (
        SELECT *, NULL AS subject, NULL::BIGINT AS measured, NULL::BIGINT AS lim FROM security UNION ALL SELECT * FROM quality_all) JOIN rules USING (rule_id))""")


@query("all_findings", S.with_ctes(*ALL_FINDINGS, select="SELECT job_id, path AS file_path, rule_id, severity, category, source, line_number FROM hits"))
def all_findings(spark, sf):
    return _findings(SC.all_findings(source_files(spark, sf))).select("job_id", "file_path", "rule_id", "severity", "category", "source", "line_number")


@query("all_findings_with_methods", S.with_ctes(*ALL_FINDINGS, select="SELECT rule_id, severity, count(*) AS findings FROM hits GROUP BY ALL"))
def all_findings_with_methods(spark, sf):
    return SC.all_findings(source_files(spark, sf)).groupBy("rule_id", "severity").agg(F.count("*").alias("findings"))


@query("enrich_findings", S.with_ctes(S.SRC, *S.QUALITY_CTES, S.rule_table(), select=f"SELECT {FINDING} FROM quality JOIN rules USING (rule_id)"))
def enrich_findings(spark, sf):
    return _findings(FN.enrich_findings(SC.quality_hits(source_files(spark, sf)), rules_frame(spark)))


@query("rule_cross", S.with_ctes(*S.SECURITY_CTES, *S.QUALITY_CTES, S.rule_table(SECURITY_RULES + QUALITY_RULES), select="""
    SELECT rule_id, count(path) AS hits, count(DISTINCT path) AS files FROM rules LEFT JOIN
      (SELECT * FROM security UNION ALL SELECT job_id, replace(path, '\\', '/') AS path, rule_id, line_number FROM quality)
    USING (rule_id) GROUP BY rule_id"""))
def rule_cross(spark, sf):
    rules = SECURITY_RULES + QUALITY_RULES
    return MT.rule_hit_counts(
        source_files(spark, sf), rules, rules_frame(spark, rules), in_scope=P.in_scan_scope("path", "content"))


@query("user_rules", S.with_ctes(S.SRC, select=f"""
    SELECT 'USER-RETURN' AS rule_id, count(*) AS hits FROM (SELECT unnest(string_split(content, {S.NL})) AS line FROM src)
    WHERE regexp_matches(line, '\\breturn\\s+\\w+;')"""))
def user_rules(spark, sf):
    """A rule table of the user's own, taken through the one-pass scan like the built-in rules."""
    table = spark.createDataFrame(
        [("USER-RETURN", "t", "d", "r", "INFO", "CODE_QUALITY", "USER", r"\breturn\s+\w+;", "raw", "line", ["return"])],
        rules_frame(spark).schema)
    found = SC.all_findings(source_files(spark, sf), rules=table, metrics=False)
    return found.groupBy("rule_id").agg(F.count("*").alias("hits"))


@query("owasp_rollup", S.with_ctes(*S.SECURITY_CTES, select="SELECT owasp_category, count(*) AS findings FROM security JOIN (VALUES "
    + ", ".join(f"('{k}', '{v}')" for k, v in C.OWASP_2021.items())
    + ") o(code, owasp_category) ON substr(rule_id, 7, 3) = code GROUP BY 1"))
def owasp_rollup(spark, sf):
    return FN.owasp_rollup(SC.security_hits(source_files(spark, sf)))


_COUNTS = "count(*) AS total, " + ", ".join(f"count(*) FILTER (severity = '{s}') AS {s.lower()}" for s in C.SEVERITIES)


@query("severity_counts", S.with_ctes(*S.SECURITY_CTES, S.rule_table(), select=f"SELECT job_id, {_COUNTS} FROM security JOIN rules USING (rule_id) GROUP BY 1"))
def severity_counts(spark, sf):
    return FN.severity_counts(SC.security_scan(source_files(spark, sf)))


@query("severity_rollup", S.with_ctes(*S.SECURITY_CTES, S.rule_table(), select=f"""
    SELECT category, language, {_COUNTS} FROM (SELECT *, {S.language()} AS language FROM security JOIN rules USING (rule_id))
    GROUP BY ROLLUP (category, language)"""))
def severity_rollup(spark, sf):
    found = SC.security_scan(source_files(spark, sf)).withColumn("language", P.detect_language("file_path"))
    return FN.severity_counts(found, ("category", "language"), rollup=True)


_RANK = "CASE severity " + " ".join(f"WHEN '{s}' THEN {i}" for i, s in enumerate(C.SEVERITIES)) + " END"


@query("ordered_findings", S.with_ctes(*S.SECURITY_CTES, S.rule_table(), select=f"""
    SELECT job_id, severity, path AS file_path, rule_id, line_number::BIGINT AS line_number FROM security JOIN rules USING (rule_id)
    ORDER BY {_RANK}, job_id, path, rule_id, line_number"""))
def ordered_findings(spark, sf):
    return _findings(FN.ordered_findings(SC.security_scan(source_files(spark, sf)))).select(
        "job_id", "severity", "file_path", "rule_id", "line_number")


@query("top_findings", S.with_ctes(*S.SECURITY_CTES, S.rule_table(), select=f"""
    SELECT job_id, severity, path AS file_path, rule_id, line_number::BIGINT AS line_number FROM security JOIN rules USING (rule_id)
    ORDER BY {_RANK}, job_id, path, rule_id, line_number LIMIT 20"""))
def top_findings(spark, sf):
    return _findings(FN.top_findings(SC.security_scan(source_files(spark, sf)), 20)).select(
        "job_id", "severity", "file_path", "rule_id", "line_number")


# ---- text shaping ---------------------------------------------------------------------------------------------------


@query("mask_source", S.with_ctes(S.SRC, S.views(), select="""
    SELECT job_id, path, md5(v_masked) AS masked, md5(v_no_comments) AS no_comments, len(v_masked) AS chars FROM views"""))
def mask_source(spark, sf):
    files = source_files(spark, sf).select("job_id", P.normalize_path("path").alias("path"), "content")
    masked = files.select("job_id", "path", T.mask_source("content").alias("m"), T.mask_source("content", True).alias("n"))
    return masked.select("job_id", "path", F.md5("m").alias("masked"), F.md5("n").alias("no_comments"),
                         F.length("m").cast("bigint").alias("chars"))


@query("explode_lines", S.with_ctes(S.SRC, select=f"""
    SELECT path, unnest(range(1, len(string_split(content, {S.NL})) + 1)) AS line_number,
           unnest(string_split(content, {S.NL})) AS line FROM src"""))
def explode_lines(spark, sf):
    lines = MT.explode_lines(source_files(spark, sf))
    return lines.select("path", F.col("line_number").cast("bigint").alias("line_number"), "line")


# Every second line feed of a file becomes one of the other line breaks, by the file's number.
_BREAKS = (12, 11, 133, 8232, 8233)
_BREAK_SQL = ", ".join(f"chr({b})" for b in _BREAKS)
BROKEN = f"""src AS MATERIALIZED (SELECT job_id, path, regexp_replace(content, '\\n([^\\n]*)\\n', chr(10) || '\\1' || ([{_BREAK_SQL}])[(len(path) % 5 + 1)::INT], 'g') AS content
    FROM ({source_files_sql()}))"""
_ANY_BREAK = "'\\r\\n|[\\n\\x0B\\f\\r\\x{85}\\x{2028}\\x{2029}]'"


def _broken_files(spark, sf):
    marks = F.array(*[F.lit(chr(b)) for b in _BREAKS])
    one = F.element_at(marks, (F.length("path") % 5 + 1).cast("int"))
    return source_files(spark, sf).withColumn("content", F.regexp_replace("content", F.lit("\n([^\n]*)\n"), F.concat(F.lit("\n$1"), one)))


@query("explode_any_lines", S.with_ctes(BROKEN, select=f"""
    SELECT path, unnest(range(1, len(string_split_regex(content, {_ANY_BREAK})) + 1)) AS line_number, unnest(string_split_regex(content, {_ANY_BREAK})) AS line FROM src"""))
def explode_any_lines(spark, sf):
    """Lines of texts with form feeds, vertical tabs, next-line and separator characters."""
    lines = MT.explode_lines(_broken_files(spark, sf))
    return lines.select("path", F.col("line_number").cast("bigint").alias("line_number"), "line")


@query("as_coded_any_lines", S.with_ctes(BROKEN, S.views(where=S.SCOPE), f"""lines AS MATERIALIZED (
    SELECT job_id, path, unnest(range(1, len(string_split_regex(v_masked, {_ANY_BREAK})) + 1)) AS n, unnest(string_split_regex(v_masked, {_ANY_BREAK})) AS v_masked FROM views)""",
    select=f"SELECT {HIT} FROM ({S.line_pass(_NO_AUTH)})"))
def as_coded_any_lines(spark, sf):
    """The line pass of the rules taken literally, on such texts."""
    return _hits(MT.line_pass(SC.scan_scope(_broken_files(spark, sf)), _NO_AUTH, any_break=("masked",)))


@query("count_lines", S.with_ctes(S.SRC, select=f"SELECT path, {S.line_count_fast('content')} AS lines FROM src"))
def count_lines(spark, sf):
    return source_files(spark, sf).select("path", T.line_count("content").cast("bigint").alias("lines"))


_RETURN = r"return\s+[^;]+;"


@query("match_lines", S.with_ctes(S.SRC, select=f"""
    SELECT DISTINCT path, 1 + {S.newlines("array_to_string(g[1:i], '') || array_to_string(m[1:i-1], '')")} AS line_number
    FROM (SELECT path, string_split_regex(content, '{_RETURN}') AS g, regexp_extract_all(content, '{_RETURN}') AS m,
                 unnest(range(1, len(regexp_extract_all(content, '{_RETURN}')) + 1)) AS i FROM src)"""))
def match_lines(spark, sf):
    lines = T.match_start_lines("content", _RETURN)
    return source_files(spark, sf).select("path", F.explode(lines.cast("array<bigint>")).alias("line_number"))


# ---- paths and filters ----------------------------------------------------------------------------------------------


@query("normalize_path", S.with_ctes(S.SRC, select="SELECT path, replace(path, '\\', '/') AS normal FROM src"))
def normalize_path(spark, sf):
    return source_files(spark, sf).select("path", P.normalize_path("path").alias("normal"))


@query("detect_language", S.with_ctes(S.SRC, select=f"SELECT path, {S.language()} AS language FROM src"))
def detect_language(spark, sf):
    return source_files(spark, sf).select("path", P.detect_language("path").alias("language"))


@query("supported_files", S.with_ctes(S.SRC, select=f"SELECT path FROM src WHERE {S.any_suffix('path', C.SUPPORTED_EXTENSIONS)}"))
def supported_files(spark, sf):
    return source_files(spark, sf).where(P.is_supported("path")).select("path")


@query("skip_dirs", S.with_ctes(S.SRC, select=f"SELECT path FROM src WHERE NOT {S.in_any_part('path', C.SKIPPED_DIRECTORIES)}"))
def skip_dirs(spark, sf):
    return source_files(spark, sf).where(~P.in_skipped_directory("path")).select("path")


@query("scan_scope", S.with_ctes(S.SRC, select=f"SELECT replace(path, '\\', '/') AS path FROM src WHERE {S.SCOPE}"))
def scan_scope(spark, sf):
    return SC.scan_scope(source_files(spark, sf)).select("path")


@query("file_kinds", S.with_ctes(S.SRC, select=f"""
    SELECT CASE WHEN {S.any_suffix('path', C.WIDE_SOURCE_EXTENSIONS)} THEN 'source'
                WHEN {S.any_suffix('path', C.WIDE_CONFIG_EXTENSIONS)} THEN 'config'
                WHEN {S.any_suffix('path', C.ARCHIVE_EXTENSIONS)} THEN 'archive' ELSE 'other' END AS kind,
           {S.in_any_part('path', C.WIDE_SKIPPED_DIRECTORIES)} AS skipped, count(*) AS files FROM src GROUP BY 1, 2"""))
def file_kinds(spark, sf):
    return source_files(spark, sf).groupBy(
        P.file_kind("path").alias("kind"), P.in_skipped_directory("path", "wide").alias("skipped")
    ).agg(F.count("*").alias("files"))


@query("file_names", S.with_ctes(S.SRC, select=r"""
    SELECT path, CASE WHEN strpos(path, '.') > 1 THEN regexp_extract(path, '\.[^.]*$') ELSE '' END AS extension,
           regexp_replace(list_last(string_split(path, '/')), '\.[^.]*$', '') AS name,
           list_last(string_split(path, '.')) IN ('""" + "', '".join(C.TEXT_EXTENSIONS) + """') AS is_text FROM src"""))
def file_names(spark, sf):
    return source_files(spark, sf).select(
        "path", P.file_extension("path").alias("extension"), P.name_without_extension("path").alias("name"),
        P.is_text_file("path").alias("is_text"))


# ---- metrics --------------------------------------------------------------------------------------------------------

# The comment state of a line comes from the last line before it that opened or closed a block.
LINE_STATE = f"""body AS (SELECT job_id, path, content, regexp_replace(content, '\\n+\\z', '') AS b FROM src),
    raw AS (SELECT job_id, path, unnest(range(1, len(string_split(b, {S.NL})) + 1)) AS n,
            unnest(string_split(b, {S.NL})) AS line FROM body WHERE b <> ''),
    flags AS (SELECT *, CASE WHEN contains(line, '*/') THEN 0 WHEN contains(line, '/*') THEN 1 END AS f,
              regexp_matches(line, '^[\\x00-\\x20]*//') AS slashes FROM raw),
    state AS (SELECT *, coalesce(last_value(f IGNORE NULLS) OVER (PARTITION BY job_id, path ORDER BY n
              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
              coalesce(last_value(f IGNORE NULLS) OVER (PARTITION BY job_id, path ORDER BY n
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS after FROM flags),
    classes AS MATERIALIZED (SELECT job_id, path, n AS line_number,
              after = 0 AND NOT contains(line, '*/') AND NOT slashes AND NOT regexp_full_match(line, '[\\x00-\\x20]*') AS is_code,
              contains(line, '/*') OR before = 1 OR slashes AS is_comment,
              regexp_full_match(line, '\\s*') AS is_blank FROM state)"""


@query("line_classes", S.with_ctes(S.SRC, LINE_STATE, select="SELECT path, line_number, is_code, is_comment, is_blank FROM classes"))
def line_classes(spark, sf):
    return MR.line_classes(source_files(spark, sf)).select(
        "path", F.col("line_number").cast("bigint").alias("line_number"), "is_code", "is_comment", "is_blank")


def _count(pattern: str) -> str:
    return f"len(regexp_extract_all(content, {S.quote(pattern)}))"


_BRANCHES = r"\b(?:" + "|".join(C.BRANCH_KEYWORDS) + r")\b"
METRICS = f"""counts AS (SELECT job_id, path, count(*) FILTER (is_code) AS loc, count(*) FILTER (is_comment) AS comment_lines,
        count(*) FILTER (is_blank) AS blank_lines FROM classes GROUP BY 1, 2),
    base AS (SELECT job_id, path, {S.language()} AS language, {S.line_count_fast('content', 0)} AS lines,
        coalesce(loc, 0) AS loc, coalesce(comment_lines, 0) AS comment_lines, coalesce(blank_lines, 0) AS blank_lines,
        {_count(C.METHOD_PATTERN)} AS methods, {_count(C.CLASS_PATTERN)} AS classes, {_count(C.IMPORT_PATTERN)} AS imports,
        1 + {_count(_BRANCHES)} + (len(content) - len(replace(content, '&&', ''))) // 2
          + (len(content) - len(replace(content, '||', ''))) // 2 + len(content) - len(replace(content, '?', '')) AS complexity
        FROM src LEFT JOIN counts USING (job_id, path)),
    metrics AS MATERIALIZED (SELECT *, CASE WHEN lines > 0 THEN 100.0::DOUBLE * comment_lines / lines ELSE 0 END AS comment_density,
        CASE WHEN methods > 0 THEN loc::DOUBLE / methods ELSE 0 END AS avg_method_length,
        CASE WHEN loc = 0 THEN 100 ELSE greatest(0, least(100,
          171 - 5.2::DOUBLE * ln(loc) - 0.23::DOUBLE * complexity - 16.2::DOUBLE * ln(loc))) END AS maintainability FROM base)"""


@query("file_metrics", S.with_ctes(S.SRC, LINE_STATE, METRICS, select=f"""
    SELECT path, language, lines, loc, comment_lines, blank_lines, methods, classes, imports, complexity::BIGINT AS complexity,
           round(comment_density, 6) AS comment_density, round(avg_method_length, 6) AS avg_method_length,
           round(maintainability, 6) AS maintainability, comment_density >= 10 AS adequate_comments FROM metrics"""))
def file_metrics(spark, sf):
    m = MR.file_metrics(source_files(spark, sf)).drop("job_id")
    return m.withColumns({c: F.round(c, 6) for c in ("comment_density", "avg_method_length", "maintainability")})


@query("metrics_rollup", S.with_ctes(S.SRC, LINE_STATE, METRICS, select="""
    SELECT language, count(*) AS files, sum(lines)::BIGINT AS lines, sum(loc)::BIGINT AS loc, max(complexity)::BIGINT AS max_complexity,
           quantile_disc(loc, 0.5) AS median_loc, round(avg(comment_density), 6) AS avg_comment_density,
           round(avg(maintainability), 6) AS avg_maintainability, count(*) FILTER (comment_density >= 10) AS adequately_commented
    FROM metrics GROUP BY 1"""))
def metrics_rollup(spark, sf):
    m = MR.metrics_rollup(MR.file_metrics(source_files(spark, sf)))
    return m.withColumns({c: F.round(c, 6) for c in ("avg_comment_density", "avg_maintainability")})


@query("total_loc", S.with_ctes(S.SRC, select=f"SELECT job_id, sum({S.line_count_fast('content')})::BIGINT AS lines FROM src GROUP BY 1"))
def total_loc(spark, sf):
    return MR.total_lines(source_files(spark, sf))


@query("files_by_language", S.with_ctes(S.SRC, select=f"SELECT job_id, {S.language()} AS language, count(*) AS files FROM src GROUP BY 1, 2"))
def files_by_language(spark, sf):
    return MR.files_by_language(source_files(spark, sf))
