"""File-path expressions: normalising, naming, language and the file filters."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as C
from .checks import is_blank


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _ends_with_any(path: Column, suffixes) -> Column:
    """One anchored regex instead of a chain of suffix tests."""
    return path.rlike("(?:" + "|".join(re.escape(s) for s in suffixes) + r")\z")


def normalize_path(path) -> Column:
    return F.coalesce(F.replace(_col(path), F.lit("\\"), F.lit("/")), F.lit(""))


def base_name(path) -> Column:
    return F.substring_index(_col(path), "/", -1)


def file_extension(path) -> Column:
    """From the last dot on, if that dot is neither the first nor the last character."""
    p = _col(path)
    return F.coalesce(F.regexp_extract(p, r"(?s)\A.+(\.[^.]+)\z", 1), F.lit(""))


def name_without_extension(path) -> Column:
    trimmed = F.regexp_replace(_col(path), r"/+\z", "")
    return F.coalesce(F.regexp_replace(base_name(trimmed), r"(?<=.)\.[^.]*\z", ""), F.lit(""))


def is_text_file(path) -> Column:
    known = r"(?i)\A\.(?:" + "|".join(C.TEXT_EXTENSIONS) + r")\z"
    return file_extension(path).rlike(known)


def detect_language(path) -> Column:
    p = _col(path)
    chain = None
    for ext, language in C.LANGUAGE_BY_EXTENSION.items():
        chain = F.when(p.endswith(ext), language) if chain is None else chain.when(p.endswith(ext), language)
    return chain.otherwise(C.UNKNOWN_LANGUAGE)


def is_supported(path, preset: str = "default") -> Column:
    exts = C.SUPPORTED_EXTENSIONS if preset == "default" else C.WIDE_SOURCE_EXTENSIONS + C.WIDE_CONFIG_EXTENSIONS
    return F.coalesce(_ends_with_any(_col(path), exts), F.lit(False))


def in_skipped_directory(path, preset: str = "default") -> Column:
    """True when any part of the *relative* path, file name included, is in the skip set."""
    names = C.SKIPPED_DIRECTORIES if preset == "default" else C.WIDE_SKIPPED_DIRECTORIES
    parts = "|".join(re.escape(n) for n in names)
    return F.coalesce(_col(path).rlike(rf"(?:\A|/)(?:{parts})(?:/|\z)"), F.lit(False))


def file_kind(path) -> Column:
    """source / config / archive / other after the wide extension sets."""
    p = _col(path)
    return (
        F.when(_ends_with_any(p, C.WIDE_SOURCE_EXTENSIONS), "source")
        .when(_ends_with_any(p, C.WIDE_CONFIG_EXTENSIONS), "config")
        .when(_ends_with_any(p, C.ARCHIVE_EXTENSIONS), "archive")
        .otherwise("other")
    )


def path_in_scope(path, excluded_names=()) -> Column:
    """A real path that is not below a test directory. One that *starts* with ``test/`` stays in scope; only an inner
    ``/test/`` part takes it out."""
    p = normalize_path(path)
    scope = ~is_blank(p) & ~p.contains("/test/")
    for name in excluded_names:
        scope = scope & ~p.endswith(name)
    return scope


def in_scan_scope(path, content, excluded_names=()) -> Column:
    """Security scan scope: a path in scope and a text that is not blank."""
    return path_in_scope(path, excluded_names) & ~is_blank(content)
