"""Predicates over text and numbers. Every predicate is null-safe: it answers true or false, never null."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C
from .json_values import is_json, is_whole_json

_BLANK = r"\A[\x00-\x20]*\z"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _no_null(c: Column, default: bool = False) -> Column:
    return F.coalesce(c, F.lit(default))


def whole(pattern: str) -> str:
    """Anchor a pattern to the whole string; ``$`` would also accept a final newline."""
    return rf"\A(?:{pattern})\z"


def java_trim(c) -> Column:
    """Cut all characters up to U+0020 at both ends (Spark's ``trim`` cuts spaces only)."""
    return F.regexp_replace(_col(c), r"\A[\x00-\x20]+|[\x00-\x20]+\z", "")


def is_empty(c) -> Column:
    return _no_null(_col(c) == "", True)


def is_blank(c) -> Column:
    return _no_null(_col(c).rlike(_BLANK), True)


def is_valid_git_url(c) -> Column:
    return _no_null(java_trim(c).rlike(whole(C.GIT_URL)))


def is_valid_url(c) -> Column:
    """A known scheme followed by a colon, optionally padded with blanks; a port, if given, must be a number."""
    schemes = "|".join(C.URL_SCHEMES)
    shape = rf"(?i)\A[\x00-\x20]*(?:url:)?(?:{schemes}):"
    bad_port = r"(?i)\A[\x00-\x20]*(?:url:)?(?:https?|ftp)://[^/?#:\[]*:(?!\d*(?:[/?#]|[\x00-\x20]*\z))"
    return _no_null(_col(c).rlike(shape) & ~_col(c).rlike(bad_port))


def is_valid_email(c) -> Column:
    return _no_null(java_trim(c).rlike(whole(C.EMAIL)))


def is_alphanumeric(c) -> Column:
    return _no_null(_col(c).rlike(whole(C.ALPHANUMERIC)))


def is_safe_file_name(c) -> Column:
    """Only letters, digits, dot, underscore and dash (so no slash either), and no double dot."""
    return _no_null(_col(c).rlike(whole(C.SAFE_FILE_NAME)) & ~_col(c).contains(".."))


def length_in_range(c, low: int, high: int) -> Column:
    return _no_null(F.length(_col(c)).between(low, high))


def in_range(c, low, high) -> Column:
    return _no_null(_col(c).between(low, high))


def is_positive(c) -> Column:
    return _no_null(_col(c) > 0)


def is_non_negative(c) -> Column:
    return _no_null(_col(c) >= 0)


def matches_pattern(c, pattern: str | None) -> Column:
    if pattern is None:
        return F.lit(False)
    return _no_null(_col(c).rlike(whole(pattern)))


def contains_any(c, needles) -> Column:
    """Plain substring search, ignoring case. ``contains`` is a byte search, far cheaper than a regex."""
    low = F.lower(_col(c))
    return _no_null(reduce(lambda a, b: a | b, [low.contains(n) for n in needles]))


def has_sql_injection_marker(c) -> Column:
    return contains_any(c, C.SQL_MARKERS)


def has_xss_marker(c) -> Column:
    return contains_any(c, C.XSS_MARKERS)


def is_valid_port(c) -> Column:
    return in_range(c, 1, 65535)


def is_valid_ipv4(c) -> Column:
    return _no_null(_col(c).rlike(whole(C.IPV4)))


def is_ascii(c) -> Column:
    return _no_null(~_col(c).rlike(r"[^\x00-\x7F]"), True)


def is_valid_json(c) -> Column:
    return ~is_blank(c) & is_json(c)


def is_whole_json_text(c) -> Column:
    """As ``is_valid_json``, which looks at the first value only, but the text must end with that value."""
    return ~is_blank(c) & is_whole_json(c)


def is_camel_case(c) -> Column:
    return matches_pattern(c, C.CAMEL_CASE)


def is_pascal_case(c) -> Column:
    return matches_pattern(c, C.PASCAL_CASE)


def is_snake_case(c) -> Column:
    return matches_pattern(c, C.SNAKE_CASE)


def is_screaming_snake_case(c) -> Column:
    return matches_pattern(c, C.SCREAMING_SNAKE_CASE)


def is_java_package(c) -> Column:
    return matches_pattern(c, C.JAVA_PACKAGE)


def is_java_class(c) -> Column:
    return matches_pattern(c, C.JAVA_CLASS)


#: name -> predicate, the checks that need no further argument (used by ``validation_profile``)
TEXT_CHECKS = {
    "is_empty": is_empty,
    "is_blank": is_blank,
    "git_url": is_valid_git_url,
    "url": is_valid_url,
    "email": is_valid_email,
    "alphanumeric": is_alphanumeric,
    "safe_file_name": is_safe_file_name,
    "sql_marker": has_sql_injection_marker,
    "xss_marker": has_xss_marker,
    "ipv4": is_valid_ipv4,
    "ascii": is_ascii,
    "json": is_whole_json_text,
    "java_package": is_java_package,
    "java_class": is_java_class,
}
NUMBER_CHECKS = {
    "positive": is_positive,
    "non_negative": is_non_negative,
    "port": is_valid_port,
}
