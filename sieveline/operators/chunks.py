"""Overlapping chunks, prompts and request bodies."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.paths import detect_language
from ..functions.text import line_count, newline_count
from .ordinals import number_rows

CHUNK_TYPE = "array<struct<chunk_index:int,total_chunks:int,content:string,start_line:int,end_line:int>>"
_STATE = "array<struct<nl:int,trail:int,len:int>>"


def _stats(text: Column) -> Column:
    """Newlines, trailing newlines and length: enough to count the lines of joined texts."""
    length = F.length(text)
    trail = length - F.length(F.rtrim(text, F.lit("\n")))
    return F.struct(newline_count(text).cast("int").alias("nl"), trail.cast("int").alias("trail"), length.alias("len"))


def _joined(a: Column, b: Column) -> Column:
    return F.struct(
        (a.nl + b.nl).alias("nl"),
        F.when(b.trail == b.len, a.trail + b.len).otherwise(b.trail).alias("trail"),
        (a.len + b.len).alias("len"),
    )


def _lines(s: Column) -> Column:
    return F.when(s.len == 0, 1).when(s.trail == s.len, 0).otherwise(s.nl - s.trail + 1)


def chunk_text(
    texts: DataFrame, keys=("job_id", "path"), content: str = "content", size: int = C.CHUNK_CHARS,
    overlap: float = C.CHUNK_OVERLAP, skip_contained_tail: bool = False,
) -> DataFrame:
    """Cut texts into chunks of ``size`` characters, each repeating the last part of the one before.

    Linear in the length of a text: it is cut once into steps, a chunk is a step plus the head of the next, and line
    bounds come from running counts instead of counting every prefix anew. ``skip_contained_tail`` leaves out a last
    chunk that lies wholly in the one before.
    """
    repeat = int(size * overlap)
    step = size - repeat
    if not 0 <= repeat <= step:
        raise ValueError("overlap must be between 0 and one half")
    key_columns = [c for c in keys]
    base = texts.where(F.col(content).isNotNull()).select(*key_columns, F.col(content).alias("_c"))
    is_long = F.length("_c") > size
    base = base.select(
        *key_columns,
        F.when(is_long, F.regexp_extract_all(F.col("_c"), F.lit(rf"(?s).{{1,{step}}}"), F.lit(0))).alias("_pieces"),
        F.when(~is_long, F.col("_c")).alias("_short"),
    )
    prefix = F.aggregate(
        F.transform("_pieces", _stats),
        F.array(F.struct(F.lit(0).alias("nl"), F.lit(0).alias("trail"), F.lit(0).alias("len"))).cast(_STATE),
        lambda acc, p: F.concat(acc, F.array(_joined(F.element_at(acc, -1), p))),
    )
    base = base.select("*", prefix.alias("_prefix"))
    n = F.size("_pieces")

    def chunk(piece: Column, i: Column) -> Column:
        head = F.coalesce(F.substring(F.try_element_at("_pieces", i + 2), 1, repeat), F.lit(""))
        return F.struct(
            i.alias("chunk_index"), n.alias("total_chunks"), F.concat(piece, head).alias("content"),
            _lines(F.element_at("_prefix", i + 1)).alias("start_line"),
            _lines(_joined(F.element_at("_prefix", i + 2), _stats(head))).alias("end_line"),
        )

    whole = F.array(F.struct(
        F.lit(0).alias("chunk_index"), F.lit(1).alias("total_chunks"), F.col("_short").alias("content"),
        F.lit(1).alias("start_line"), line_count("_short").alias("end_line"),
    ))
    chunks = F.when(F.col("_pieces").isNotNull(), F.transform("_pieces", chunk)).otherwise(whole)
    out = base.select(*key_columns, F.inline(chunks))
    if skip_contained_tail:
        out = out.where((F.col("chunk_index") == 0) | (F.length("content") > repeat))
    return out


def with_language(chunks: DataFrame, path: str = "path") -> DataFrame:
    return chunks.withColumn("language", detect_language(path))


CHUNK_PROMPT = """Excerpt {number}/{total} of {file}, lines {start}-{end}, written in {language}. It belongs to {project}.

<excerpt>
{code}
</excerpt>

A maintainer takes this file over tomorrow. Tell them what would surprise them: hidden state, errors that are swallowed, code that
only works in one order, values that should be settings, behaviour no test could pin down. Leave style alone, and report nothing
that the excerpt does not show. An empty list of findings is a good answer.

Reply with one JSON object and no other text. Its keys: "summary", what the file does, as a string; "findings", a list of objects
with "title", "description", "recommendation", "severity" (HIGH, MEDIUM, LOW or INFO) and "lineHint", a line number in the excerpt.
"""
PROJECT_PROMPT = """Notes on the files of {project}, one to a line:
- {summaries}

From these notes alone, say how the parts hang together and what to change first. Reply with one JSON object and no other text. Its
keys: "executiveSummary", for a reader who does not program; "architecturalAssessment", for one who does; "topRecommendations", a
list of strings, the most useful five at most.
"""


def fill(template: str, values: dict[str, Column]) -> Column:
    """A text column from a template whose ``{name}`` fields are columns."""
    pattern = "({" + "}|{".join(re.escape(v) for v in values) + "})"
    parts = [p for p in re.split(pattern, template) if p]
    return F.concat(*[values[p[1:-1]] if p[0] == "{" and p[1:-1] in values else F.lit(p) for p in parts])


def chunk_prompts(chunks: DataFrame, project: Column | str | None = None, template: str = CHUNK_PROMPT) -> DataFrame:
    """Add ``prompt``. Expects file_path, chunk_index, total_chunks, content, language, start_line, end_line."""
    name = F.lit(project) if isinstance(project, str) or project is None else project
    return chunks.withColumn("prompt", fill(template, {
        "project": F.coalesce(name.cast("string"), F.lit(C.PROMPT_PROJECT)),
        "file": F.col("file_path"),
        "number": (F.col("chunk_index") + 1).cast("string"),
        "total": F.col("total_chunks").cast("string"),
        "start": F.col("start_line").cast("string"),
        "end": F.col("end_line").cast("string"),
        "language": F.col("language"),
        "code": F.col("content"),
    }))


def project_bullets(summaries: DataFrame) -> DataFrame:
    """(job_id, ordinal, bullet): the chunk summaries of a project in file and chunk order, numbered from 1 without gaps.

    The form is the same at any size. The ordinals are prefix sums over range partitions (``number_rows``), so no task has to hold
    a project or a large file. Expects job_id, file_path, chunk_index, summary.
    """
    rows = summaries.select("job_id", "file_path", "chunk_index", F.col("summary").alias("bullet"))
    return number_rows(rows, ["job_id"], ["file_path", "chunk_index", "bullet"]).select("job_id", "ordinal", "bullet")


def _prompts(bullets: DataFrame, keys, project: Column | None, template: str) -> DataFrame:
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "bullet")))
    text = F.array_join(F.transform(ordered, lambda b: b.bullet), "\n- ")
    grouped = bullets.groupBy(*keys).agg(F.count("*").alias("summaries"), text.alias("_bullets"))
    name = project if project is not None else F.lit(None).cast("string")
    values = {"project": F.coalesce(name, F.lit(C.PROMPT_PROJECT)), "summaries": F.col("_bullets")}
    return grouped.select(*keys, "summaries", fill(template, values).alias("prompt"))


def prompt_pages(
    bullets: DataFrame, page_size: int, project: Column | None = None, template: str = PROJECT_PROMPT
) -> DataFrame:
    """(job_id, part, parts, summaries, prompt): the bullets of ``project_bullets`` as prompts of ``page_size`` bullets,
    the last one of a job with what is left. Parts follow the order of the bullets and are numbered from 0 without gaps."""
    if page_size < 1:
        raise ValueError("page_size must be at least 1")
    sizes = bullets.groupBy(F.col("job_id").alias("_job")).agg(F.ceil(F.count("*") / page_size).cast("int").alias("parts"))
    part = F.floor((F.col("ordinal") - 1) / page_size).cast("int")
    placed = bullets.withColumn("part", part).join(sizes, F.col("job_id").eqNullSafe(F.col("_job")))
    return _prompts(placed, ("job_id", "part", "parts"), project, template)


def project_prompts(
    summaries: DataFrame, project: Column | None = None, per_prompt: int | None = None, template: str = PROJECT_PROMPT
) -> DataFrame:
    """(job_id, part, parts, summaries, prompt): the chunk summaries of a project as one bullet list in one prompt, however
    many there are. With ``per_prompt`` they are paged by ``prompt_pages``. Expects job_id, file_path, chunk_index, summary.
    """
    if per_prompt is not None:
        return prompt_pages(project_bullets(summaries), per_prompt, project, template)
    bullets = summaries.select("job_id", F.struct("file_path", "chunk_index").alias("ordinal"), F.col("summary").alias("bullet"))
    whole = _prompts(bullets, ("job_id",), project, template)
    return whole.select("job_id", F.lit(0).alias("part"), F.lit(1).alias("parts"), "summaries", "prompt")


def inference_requests(
    prompts: DataFrame, shape: str = "messages", model: str = "model", project_id: str = "",
    max_tokens: int = C.MAX_REPLY_TOKENS,
) -> DataFrame:
    """Add ``body``, the JSON request of an offline batch run: chat ``messages``, or ``input`` with parameters."""
    if shape == "messages":
        body = F.struct(
            F.lit(model).alias("model"), F.lit(max_tokens).alias("max_tokens"),
            F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content"))).alias("messages"),
        )
    elif shape == "input":
        body = F.struct(
            F.lit(model).alias("model_id"), F.lit(project_id).alias("project_id"), F.col("prompt").alias("input"),
            F.struct(
                F.lit(max_tokens).alias("max_new_tokens"), F.lit(C.REPLY_TEMPERATURE).alias("temperature"),
                F.lit(C.REPLY_TOP_P).alias("top_p"),
            ).alias("parameters"),
        )
    else:
        raise ValueError(f"unknown request shape: {shape}")
    return prompts.withColumn("body", F.to_json(body))
