"""SQL building blocks for the expected results. They restate the semantics in their own way: line numbers from the
gaps between matches, comment state from windows, look-aheads from positions."""

from __future__ import annotations

import re

from sieveline.functions import constants as C
from sieveline.operators.rule_catalog import CATALOG, QUALITY_RULES, SECURITY_RULES

from .source_tables import quote, source_files_sql

LEXER = (
    r"/\*(?s:.*?)(?:\*/|\z)|//[^\n]*|" + r'"(?:[^"\\\n]|\\[^\n]?)*"?|' + r"'(?:[^'\\\n]|\\[^\n]?)*'?|" + r"""[^/"']+|/"""
)
SRC = f"src AS MATERIALIZED ({source_files_sql()})"
NL = "chr(10)"


def newlines(expr: str) -> str:
    return f"(len({expr}) - len(replace({expr}, {NL}, '')))"


def language(path: str = "path") -> str:
    whens = " ".join(f"WHEN ends_with({path}, '{e}') THEN '{l}'" for e, l in C.LANGUAGE_BY_EXTENSION.items())
    return f"(CASE {whens} ELSE 'unknown' END)"


def any_suffix(path: str, suffixes) -> str:
    return "(" + " OR ".join(f"ends_with({path}, '{s}')" for s in suffixes) + ")"


def in_any_part(path: str, names) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return f"list_has_any(string_split({path}, '/'), [{listed}])"


def line_count_fast(text: str, empty: int = 1) -> str:
    kept = rf"regexp_replace({text}, '\n+\z', '')"
    return f"(CASE WHEN {text} = '' THEN {empty} WHEN {kept} = '' THEN 0 ELSE len(string_split({kept}, {NL})) END)"


def views(source: str = "src", where: str = "TRUE") -> str:
    def blanked(test: str) -> str:
        return rf"""array_to_string(list_transform(ps, lambda p: CASE WHEN {test}
            THEN regexp_replace(p, '[^\n]', ' ', 'g') ELSE p END), '')"""

    comment = "starts_with(p, '//') OR starts_with(p, '/*')"
    literal = comment + " OR starts_with(p, '\"') OR starts_with(p, '''')"
    return f"""pieces AS MATERIALIZED (SELECT job_id, replace(path, '\\', '/') AS path, content,
        regexp_extract_all(content, {quote(LEXER)}) AS ps FROM {source} WHERE {where}),
    views AS MATERIALIZED (SELECT job_id, path, content AS v_raw, {blanked(comment)} AS v_no_comments, {blanked(literal)} AS v_masked
        FROM pieces)"""


SCOPE = r"""NOT regexp_full_match(replace(path, '\', '/'), '\s*') AND NOT regexp_full_match(content, '\s*')
    AND NOT contains(replace(path, '\', '/'), '/test/')"""

LINES = f"""lines AS MATERIALIZED (SELECT job_id, path, unnest(range(1, len(string_split(v_raw, {NL})) + 1)) AS n,
    unnest(string_split(v_raw, {NL})) AS v_raw, unnest(string_split(v_no_comments, {NL})) AS v_no_comments,
    unnest(string_split(v_masked, {NL})) AS v_masked FROM views)"""


def _line_test(rule, column: str) -> str:
    """Does the rule fire on this line? Look-aheads are restated with extracted groups."""
    if rule.rule_id == "OWASP-A02-CRED-001":
        first = r'(?i)(?:password|passwd|secret|access[_-]?token)\s*=\s*"([^"]{8,})"'
        second = r'(?i)(?:api[_-]?key)\s*=\s*"([^"]{12,})"'
        return (
            f"(len(list_filter(regexp_extract_all({column}, {quote(first)}, 1), lambda x: NOT regexp_matches(x,"
            f" '(?i)^(your-|change-me|example|dummy|test)'))) > 0 OR len(list_filter(regexp_extract_all({column},"
            f" {quote(second)}, 1), lambda x: NOT regexp_matches(x, '(?i)^(x-api-key|api-key|authorization|content-type)'))) > 0)"
        )
    if rule.rule_id == "QA-STATIC-001":
        return (
            rf"len(list_filter(regexp_extract_all({column}, 'private static (\w+)\s+\w+\s*=', 1),"
            " lambda x: NOT starts_with(x, 'final'))) > 0"
        )
    return f"regexp_matches({column}, {quote(rule.pattern)})"


def line_pass(rules) -> str:
    parts = [
        f"SELECT job_id, path, '{r.rule_id}' AS rule_id, n AS line_number FROM lines WHERE {_line_test(r, 'v_' + r.view)}"
        for r in rules if r.scope in ("line", "both")
    ]
    return " UNION ALL ".join(parts)


_MAPPING = r"(?i)@(?:GetMapping|PostMapping|PutMapping|DeleteMapping|RequestMapping)"


def _auth_pass(rule) -> str:
    """Annotations with none of the words within 250 characters after them, from positions instead of a look-ahead."""
    words = ["health", "actuator", "login", "register", "public", "status", "@preauthorize", "@secured", "@rolesallowed"]
    far = " AND ".join(f"NOT contains(lower(substr(rest, 1, {250 + len(w)})), '{w}')" for w in words)
    return f"""SELECT DISTINCT job_id, path, '{rule.rule_id}' AS rule_id, line_number FROM (
        SELECT job_id, path, 1 + {newlines("array_to_string(g[1:i], '') || array_to_string(m[1:i-1], '')")} AS line_number,
               substr(v, len(array_to_string(g[1:i], '')) + len(array_to_string(m[1:i], '')) + 1, 300) AS rest
        FROM (SELECT job_id, path, v_no_comments AS v, string_split_regex(v_no_comments, {quote(_MAPPING)}) AS g,
                     regexp_extract_all(v_no_comments, {quote(_MAPPING)}) AS m,
                     unnest(range(1, len(regexp_extract_all(v_no_comments, {quote(_MAPPING)})) + 1)) AS i
              FROM views WHERE regexp_matches(v_no_comments, {quote(_MAPPING)}))) WHERE {far}"""


def text_pass(rules) -> str:
    """Start lines of the matches in the whole text, from the gaps between them."""
    parts = []
    for r in rules:
        if r.scope not in ("text", "both"):
            continue
        if r.rule_id == "OWASP-A01-AUTH-001":
            parts.append(_auth_pass(r))
            continue
        if r.rule_id == "OWASP-A02-CRED-001":
            # literals do not span lines in the derived files: the whole-text hits are the line hits
            parts.append(f"SELECT job_id, path, '{r.rule_id}' AS rule_id, n AS line_number FROM lines"
                         f" WHERE {_line_test(r, 'v_' + r.view)}")
            continue
        p, v = quote(r.pattern), f"v_{r.view}"
        parts.append(f"""SELECT DISTINCT job_id, path, '{r.rule_id}' AS rule_id,
            1 + {newlines("array_to_string(g[1:i], '') || array_to_string(m[1:i-1], '')")} AS line_number
            FROM (SELECT job_id, path, string_split_regex({v}, {p}) AS g, regexp_extract_all({v}, {p}) AS m,
                         unnest(range(1, len(regexp_extract_all({v}, {p})) + 1)) AS i
                  FROM views WHERE regexp_matches({v}, {p}))""")
    return " UNION ALL ".join(parts)


def with_ctes(*ctes: str, select: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + select


SECURITY_CTES = (
    SRC, views(where=SCOPE), LINES,
    f"sec_line AS MATERIALIZED ({line_pass(SECURITY_RULES)})",
    f"sec_text AS MATERIALIZED ({text_pass(SECURITY_RULES)})",
    "security AS MATERIALIZED (SELECT * FROM sec_line UNION SELECT * FROM sec_text)",
)


def _renamed(cte: str) -> str:
    """The same CTE under names of its own, for queries that need both scans."""
    for name in ("pieces", "views", "lines"):
        cte = re.sub(rf"\b{name}\b", f"q_{name}", cte)
    return cte


QUALITY_CTES = tuple(_renamed(c) for c in (
    # quality rules see every file under its own path
    views().replace("replace(path, '\\', '/') AS path", "path"), LINES,
    f"quality AS MATERIALIZED (SELECT * FROM ({line_pass(QUALITY_RULES)}) UNION SELECT * FROM ({text_pass(QUALITY_RULES)}))",
))


def rule_table(rules=CATALOG) -> str:
    rows = ", ".join(
        "(" + ", ".join(quote(x) for x in (r.rule_id, r.title, r.description, r.recommendation, r.severity, r.category, r.source)) + ")"
        for r in rules
    )
    return ("rules AS (SELECT * FROM (VALUES " + rows
            + ") t(rule_id, title, description, recommendation, severity, category, source))")


LARGE_FILES = f"""large AS MATERIALIZED (SELECT job_id, path, 'QA-GOD-CLASS-001' AS rule_id, 1 AS line_number,
    {line_count_fast('content')} AS measured FROM src WHERE {line_count_fast('content')} > {C.MAX_FILE_LINES})"""
