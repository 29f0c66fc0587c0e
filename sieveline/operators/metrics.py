"""Per-line classes and per-file metrics. No window and no shuffle: block comments are found by pattern inside the
row, so a text is never taken apart into rows just to carry a flag from line to line."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions import text as T
from ..functions.paths import detect_language

_GAP = r"[\x00-\x09\x0b-\x20]*+"
_BLANK_LINE = r"(?md)^[ \t\x0B\f\r]*+$"
_CODE_LINE = rf"(?md)^(?!{_GAP}(?://|$))(?![^\n]*\*/)"
# Everything ahead of the word is optional in the class pattern, so the words alone give the same count, and a regex
# that starts with a letter is far cheaper than one that may start with nothing.
_CLASS_WORDS = r"class\s+\w+"
_COMMENT_LINE = rf"(?md)^(?:{_GAP}//|[^\n]*/\*)"


def line_classes(files: DataFrame, keys=("job_id", "path"), content: str = "content") -> DataFrame:
    """One row per line with ``is_code``, ``is_comment`` and ``is_blank``, each as the file metrics count it."""
    body = files.where(F.coalesce(F.col(content), F.lit("")) != "").select(
        *keys, T.strip_trailing_newlines(content).alias("_body")
    )
    lines = body.where(F.col("_body") != "").select(*keys, F.posexplode(T.classified_lines("_body")).alias("_pos", "_l"))
    line = F.col("_l.line")
    slashes = line.rlike(rf"\A{_GAP}//")
    return lines.select(
        *keys,
        (F.col("_pos") + 1).alias("line_number"),
        (~F.col("_l.in_run") & ~slashes & ~line.contains("*/") & ~line.rlike(r"\A[\x00-\x20]*\z")).alias("is_code"),
        (F.col("_l.in_run") | slashes | line.contains("/*")).alias("is_comment"),
        line.rlike(r"\A\s*\z").alias("is_blank"),
    )


def estimated_complexity(content, as_coded: bool = False) -> Column:
    """1 + branch keywords + branch operators. ``as_coded`` reads the operators as patterns between word boundaries,
    which makes ``||`` match everywhere."""
    text = F.col(content) if isinstance(content, str) else content
    words = r"\b(?:" + "|".join(C.BRANCH_KEYWORDS) + r")\b"
    if as_coded:
        operators = [rf"\b{op}\b" for op in C.BRANCH_OPERATORS]
    else:
        operators = ["|".join(re.escape(op) for op in C.BRANCH_OPERATORS)]
    total = F.lit(1) + F.regexp_count(text, F.lit(words))
    for pattern in operators:
        total = total + F.regexp_count(text, F.lit(pattern))
    return total


def file_metrics(files: DataFrame, keys=("job_id", "path"), content: str = "content", as_coded: bool = False) -> DataFrame:
    """One row per file: line counts, declarations, complexity, density, mean method length, maintainability."""
    text = F.coalesce(F.col(content), F.lit(""))
    staged = files.select(*keys, text.alias("_t")).select(*keys, "_t", T.strip_trailing_newlines("_t").alias("_b"))
    staged = staged.select("*", T.comment_runs("_b").alias("_runs"), T.outside_comment_runs("_b").alias("_out"))
    some = F.col("_t") != ""

    def count(column: str, pattern: str) -> Column:
        return F.regexp_count(F.col(column), F.lit(pattern))

    run_lines = F.when(F.size("_runs") > 0, T.newline_count(F.array_join("_runs", "\n")) + 1).otherwise(0)
    lines = T.line_count("_t", empty_is=0)
    counted = staged.select(
        *keys,
        detect_language("path").alias("language") if "path" in keys else F.lit(C.UNKNOWN_LANGUAGE).alias("language"),
        lines.cast("bigint").alias("lines"),
        F.when(F.col("_b") != "", count("_out", _CODE_LINE)).otherwise(0).cast("bigint").alias("loc"),
        F.when(F.col("_b") != "", count("_out", _COMMENT_LINE) + run_lines).otherwise(0).cast("bigint").alias("comment_lines"),
        F.when(F.col("_b") != "", count("_b", _BLANK_LINE)).otherwise(0).cast("bigint").alias("blank_lines"),
        count("_t", C.METHOD_PATTERN).cast("bigint").alias("methods"),
        count("_t", _CLASS_WORDS).cast("bigint").alias("classes"),
        count("_t", C.IMPORT_PATTERN).cast("bigint").alias("imports"),
        F.when(some, estimated_complexity("_t", as_coded)).otherwise(0).cast("bigint").alias("complexity"),
    )
    index = 171 - 5.2 * F.ln("loc") - 0.23 * F.col("complexity") - 16.2 * F.ln("loc")
    density = F.when(F.col("lines") > 0, F.col("comment_lines") * 100.0 / F.col("lines")).otherwise(0.0)
    return counted.select(
        "*",
        density.alias("comment_density"),
        F.when(F.col("methods") > 0, F.col("loc") / F.col("methods")).otherwise(0.0).alias("avg_method_length"),
        F.when(F.col("loc") == 0, 100.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), index))).alias("maintainability"),
        (density >= C.MIN_COMMENT_DENSITY).alias("adequate_comments"),
    )


def metrics_rollup(metrics: DataFrame, by=("language",), accuracy: int = 1_000_000) -> DataFrame:
    """Project roll-up of file metrics. Every aggregate has a small, mergeable buffer, so hot groups do not matter."""
    return metrics.groupBy(*by).agg(
        F.count("*").alias("files"),
        F.sum("lines").alias("lines"),
        F.sum("loc").alias("loc"),
        F.max("complexity").alias("max_complexity"),
        F.percentile_approx("loc", 0.5, accuracy).alias("median_loc"),
        F.avg("comment_density").alias("avg_comment_density"),
        F.avg("maintainability").alias("avg_maintainability"),
        F.count_if("adequate_comments").alias("adequately_commented"),
    )


def total_lines(files: DataFrame, by=("job_id",), content: str = "content") -> DataFrame:
    """Raw lines per job: blank and comment lines included, an empty text counts as one line."""
    return files.groupBy(*by).agg(F.sum(T.line_count(content)).cast("bigint").alias("lines"))


def files_by_language(files: DataFrame, by=("job_id",)) -> DataFrame:
    return files.groupBy(*by, detect_language("path").alias("language")).agg(F.count("*").alias("files"))
