"""Jobs over whole columns: validation profile, naming audit, cleaning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks as K
from ..functions import cleaning as CL
from ..functions.text import mask_source


def validation_profile(frame: DataFrame, checks: dict[str, dict[str, Column]], weight: str | None = None) -> DataFrame:
    """``checks`` maps a column name to {check name: predicate}. One scan and one row of counters per task; gives
    (column, check, rows, passes, failures, share). ``weight`` names a column that says for how many rows a row stands."""
    pairs = [(c, n, p) for c, by_name in checks.items() for n, p in by_name.items()]
    if weight is None:
        total, passes = F.count("*"), F.count_if
    else:
        total = F.coalesce(F.sum(weight), F.lit(0))
        passes = lambda p: F.coalesce(F.sum(F.when(p, F.col(weight))), F.lit(0))
    counts = frame.agg(total.alias("n"), *[passes(p).alias(f"p{i}") for i, (_, _, p) in enumerate(pairs)])
    rows = [
        F.struct(F.lit(c).alias("column"), F.lit(n).alias("check"), F.col("n").alias("rows"), F.col(f"p{i}").alias("passes"))
        for i, (c, n, _) in enumerate(pairs)
    ]
    return counts.select(F.inline(F.array(*rows))).select(
        "*",
        (F.col("rows") - F.col("passes")).alias("failures"),
        F.when(F.col("rows") > 0, F.col("passes") / F.col("rows")).otherwise(0.0).alias("share"),
    )


def value_profile(frame: DataFrame, column: str, checks: dict[str, Column]) -> DataFrame:
    """The validation profile of one column whose values repeat, such as words: equal values are counted first, within the tasks and
    then over all, and each is checked once."""
    counted = frame.groupBy(column).agg(F.count("*").alias("_n"))
    return validation_profile(counted, {column: checks}, "_n")


def text_checks(column: str) -> dict[str, Column]:
    return {name: check(column) for name, check in K.TEXT_CHECKS.items()}


def number_checks(column: str) -> dict[str, Column]:
    return {name: check(column) for name, check in K.NUMBER_CHECKS.items()}


def marker_counts(frame: DataFrame, column: str, markers, key: str = "marker") -> DataFrame:
    """Rows holding each marker, ignoring case."""
    low = F.lower(F.col(column))
    return validation_profile(frame, {column: {m: F.coalesce(low.contains(m), F.lit(False)) for m in markers}}).select(
        F.col("check").alias(key), "rows", F.col("passes").alias("hits")
    )


def identifiers(files: DataFrame, content: str = "content") -> DataFrame:
    """(identifier, occurrences) over all files, comments and literals left out. Repeats within a text are counted
    before anything is shuffled."""
    names = F.regexp_extract_all(mask_source(content), F.lit(r"(?<![\w$])[A-Za-z_][\w]*"), F.lit(0))
    return files.select(F.explode(names).alias("identifier")).groupBy("identifier").agg(F.count("*").alias("occurrences"))


CONVENTIONS = {
    "camel": K.is_camel_case,
    "pascal": K.is_pascal_case,
    "snake": K.is_snake_case,
    "screaming_snake": K.is_screaming_snake_case,
    "java_package": K.is_java_package,
    "java_class": K.is_java_class,
}


def naming_audit(names: DataFrame, column: str = "identifier", weight: str = "occurrences") -> DataFrame:
    """Per convention: distinct identifiers, occurrences and shares. A name may follow several conventions."""
    tests = {n: test(column) for n, test in CONVENTIONS.items()}
    counts = names.agg(
        F.count("*").alias("n"), F.sum(weight).alias("w"),
        *[F.count_if(t).alias(f"n_{k}") for k, t in tests.items()],
        *[F.sum(F.when(t, F.col(weight)).otherwise(0)).alias(f"w_{k}") for k, t in tests.items()],
    )
    rows = [
        F.struct(
            F.lit(k).alias("convention"), F.col(f"n_{k}").alias("identifiers"), F.col(f"w_{k}").alias("occurrences"),
            (F.col(f"n_{k}") / F.col("n")).alias("identifier_share"), (F.col(f"w_{k}") / F.col("w")).alias("occurrence_share"),
        )
        for k in tests
    ]
    return counts.select(F.inline(F.array(*rows)))


def rename_suggestions(names: DataFrame, column: str = "identifier") -> DataFrame:
    """The snake and camel form of every identifier that would change."""
    return names.select(
        column, "occurrences", CL.camel_to_snake(column).alias("snake_form"), CL.snake_to_camel(column).alias("camel_form")
    ).where((F.col("snake_form") != F.col(column)) | (F.col("camel_form") != F.col(column)))


def clean_text(frame: DataFrame, column: str, steps=("line_endings", "sanitize"), into: str | None = None) -> DataFrame:
    """Apply cleaning steps in order into a new column (default ``<column>_clean``)."""
    out = F.col(column)
    for step in steps:
        out = CL.CLEANERS[step](out) if isinstance(step, str) else step(out)
    return frame.withColumn(into or f"{column}_clean", out)


def cleaning_counts(frame: DataFrame, column: str, steps=tuple(CL.CLEANERS)) -> DataFrame:
    """Per cleaning step: rows, rows it changes, and the characters it leaves. One scan."""
    cleaned = frame.select(F.col(column).alias("_t"), *[CL.CLEANERS[s](column).alias(s) for s in steps])
    counts = cleaned.agg(
        F.count("*").alias("n"),
        *[F.count_if(~F.col(s).eqNullSafe(F.col("_t"))).alias(f"c_{s}") for s in steps],
        *[F.sum(F.coalesce(F.length(s), F.lit(0))).cast("bigint").alias(f"l_{s}") for s in steps],
    )
    rows = [
        F.struct(F.lit(s).alias("step"), F.col("n").alias("rows"), F.col(f"c_{s}").alias("changed"), F.col(f"l_{s}").alias("chars"))
        for s in steps
    ]
    return counts.select(F.inline(F.array(*rows)))
