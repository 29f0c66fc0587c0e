"""Text rewriting expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize_line_endings(c) -> Column:
    text = _col(c)
    return F.when(text.contains("\r"), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text)


def sanitize(c, keep_unicode: bool = False) -> Column:
    """Keep printable ASCII only. Line breaks and tabs go too; ``keep_unicode`` drops control characters only."""
    return F.regexp_replace(_col(c), r"\p{Cntrl}" if keep_unicode else r"[^\x20-\x7E]", "")


def remove_whitespace(c) -> Column:
    return F.regexp_replace(_col(c), r"\s+", "")


def truncate(c, limit: int) -> Column:
    """At most ``limit`` characters, the last three being dots when something was cut."""
    if limit < 3:
        raise ValueError("limit must be at least 3")
    text = _col(c)
    return F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit - 3), F.lit("..."))).otherwise(text)


def first_words(c, count: int) -> Column:
    if count <= 0:
        return F.lit("")
    text = F.regexp_replace(_col(c), r"\s+\z", "")
    return F.coalesce(F.array_join(F.slice(F.split(text, r"\s+", -1), 1, count), " "), F.lit(""))


def sanitize_file_name(c) -> Column:
    text = _col(c)
    return F.when(F.coalesce(text, F.lit("")) == "", "unnamed").otherwise(
        F.regexp_replace(text, r"[^a-zA-Z0-9._-]", "_")
    )


def camel_to_snake(c) -> Column:
    return F.lower(F.regexp_replace(_col(c), r"([a-z])([A-Z])", "$1_$2"))


def snake_to_camel(c) -> Column:
    """Drop underscores and raise the letter after each; the rest keeps its case."""
    return F.array_join(
        F.transform(
            F.split(_col(c), "_", -1),
            lambda part, i: F.when(i == 0, part).otherwise(
                F.concat(F.upper(F.substring(part, 1, 1)), F.substring(part, 2, 2**31 - 1))
            ),
        ),
        "",
    )


#: name -> expression, used by ``clean_text``
CLEANERS = {
    "sanitize": sanitize,
    "line_endings": normalize_line_endings,
    "no_whitespace": remove_whitespace,
    "truncate": lambda c: truncate(c, 200),
    "first_words": lambda c: first_words(c, 20),
    "file_name": sanitize_file_name,
}
