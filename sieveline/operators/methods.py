"""Method facts of Java-like sources: name, lines, parameters, decisions, control nesting.

The masked text goes to an Arrow function that reads its tokens once (:mod:`java_tokens`): brackets nest to any depth, which column
expressions cannot follow. It works inside the row: no shuffle, no token table, and memory in proportion to one text.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.cleaning import normalize_line_endings
from ..functions.text import mask_source
from .java_tokens import method_facts_of

METHOD_TYPE = "array<struct<name:string,start_line:int,end_line:int,n_params:int,complexity:int,nesting:int>>"
_FIELDS = ("name", "start_line", "end_line", "n_params", "complexity", "nesting")


def _facts_of_texts(boolean_ops: bool):
    def facts(texts: pa.Array) -> pa.Array:
        offsets, rows, missing = [0], [], []
        for text in texts:
            found = method_facts_of(text.as_py(), boolean_ops) if text.is_valid else ()
            missing.append(not text.is_valid)
            rows.extend(found)
            offsets.append(len(rows))
        columns = [pa.array([r[i] for r in rows], pa.int32() if i else pa.string()) for i in range(len(_FIELDS))]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, _FIELDS), mask=pa.array(missing))

    return F.arrow_udf(facts, METHOD_TYPE)


def method_array(masked: Column, count_boolean_ops: bool) -> Column:
    """array<struct<name, start_line, end_line, n_params, complexity, nesting>> of masked text; null where the text is null."""
    return _facts_of_texts(count_boolean_ops)(masked)


def may_have_methods(masked: Column) -> Column:
    return masked.contains("(") & (masked.contains("{") | masked.contains(";"))


# Words that open a control or decide something; a method has no more decisions and no deeper nesting than these.
_CONTROLS = r"\?|(?<![\w$])(?:if|else|for|while|do|switch|case|default|try|catch|finally)(?![\w$])"


def may_pass_a_limit(text: Column, limits: dict[str, int]) -> Column:
    """Whether a method of the text can be over a limit: a text with too few lines, commas and control words for that has none, be it
    masked or not. The line ends must be line feeds."""
    length = F.length(text)

    def count(char: str) -> Column:
        return length - F.length(F.replace(text, F.lit(char), F.lit("")))

    deepest = min(limits["QA-COMPLEXITY-001"], limits["QA-NESTING-001"] + 1)
    return (
        (count("\n") > limits["QA-LONG-METHOD-001"])
        | (count(",") >= limits["QA-PARAMS-001"])
        | (F.regexp_count(text, F.lit(_CONTROLS)) >= deepest)
    )


def method_facts(files: DataFrame, keys=("job_id", "path"), count_boolean_ops: bool = False) -> DataFrame:
    """One row per method of the ``.java`` files. Constructors are not methods here; a method whose body is not
    closed gives no row."""
    masked = files.where(F.col("path").endswith(".java") & F.col("content").isNotNull()).select(
        *keys, mask_source(normalize_line_endings("content")).alias("masked")
    )
    # into the generator as an expression: as a column, a filter on it would be inferred, and computed on its own
    return masked.select(*keys, F.inline(method_array(F.when(may_have_methods(F.col("masked")), F.col("masked")), count_boolean_ops)))


def measure_array(facts: Column, limits: dict[str, int]) -> Column:
    """array<struct<rule_id, line_number, subject, measured>> of the methods over a limit."""

    def over(f: Column) -> Column:
        measures = {
            "QA-LONG-METHOD-001": f.end_line - f.start_line,
            "QA-PARAMS-001": f.n_params,
            "QA-COMPLEXITY-001": f.complexity,
            "QA-NESTING-001": f.nesting,
        }
        return F.array(*[
            F.when(measures[rule] > limits[rule], F.struct(
                F.lit(rule).alias("rule_id"), f.start_line.alias("line_number"),
                f["name"].alias("subject"), measures[rule].alias("measured"),
            ))
            for rule in measures
        ])

    return F.filter(F.flatten(F.transform(facts, over)), lambda m: m.isNotNull())


def method_measures(facts: DataFrame, limits: dict[str, int] | None = None, keys=("job_id", "path")) -> DataFrame:
    """Rows of (keys, rule_id, line_number, subject, measured) for the methods of a fact table over a limit."""
    one = F.array(F.struct(*[F.col(c) for c in ("name", "start_line", "end_line", "n_params", "complexity", "nesting")]))
    return facts.select(*keys, F.inline(measure_array(one, {**DEFAULT_LIMITS, **(limits or {})})))


DEFAULT_LIMITS = {
    "QA-LONG-METHOD-001": C.MAX_METHOD_LENGTH,
    "QA-PARAMS-001": C.MAX_PARAMETERS,
    "QA-COMPLEXITY-001": C.MAX_COMPLEXITY,
    "QA-NESTING-001": C.MAX_NESTING,
    "QA-GOD-CLASS-001": C.MAX_FILE_LINES,
}
