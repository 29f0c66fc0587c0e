"""Analysis requests and uploads as tables: routing and rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import constants as C
from ..functions.checks import is_blank, is_safe_file_name, is_valid_git_url
from .archives import archive_sources


def route_requests(requests: DataFrame) -> DataFrame:
    """Add ``route`` (git, raw, reject) and ``reject_reason`` after the input type. An upload does not come this way,
    a git request needs a valid URL."""
    kind = F.col("input_type")
    reason = (
        F.when(kind == "FILE_UPLOAD", "uploads have their own entry")
        .when((kind == "GIT_URL") & ~is_valid_git_url("git_url"), "invalid git url")
        .when(~F.coalesce(kind, F.lit("")).isin("GIT_URL", "RAW_CODE"), "unknown input type")
    )
    route = F.when(reason.isNotNull(), "reject").when(kind == "GIT_URL", "git").otherwise("raw")
    return requests.withColumns({"route": route, "reject_reason": reason})


def raw_snippets(requests: DataFrame) -> DataFrame:
    """(job_id, path, content) of the raw-code requests; a blank name becomes the default file name."""
    name = F.when(is_blank("file_name"), C.DEFAULT_FILE_NAME).otherwise(F.col("file_name"))
    raw = requests.where(F.col("input_type") == "RAW_CODE")
    return raw.select("job_id", name.alias("path"), F.col("raw_code").alias("content"))


def route_uploads(uploads: DataFrame) -> DataFrame:
    """Add ``route`` (archive, file, reject) and ``reject_reason``. Expects file_name and length."""
    reason = (
        F.when(F.coalesce("length", F.lit(0)) == 0, "empty file")
        .when(~is_safe_file_name("file_name"), "unsafe file name")
        .when(F.col("length") > C.MAX_UPLOAD_BYTES, "larger than the upload limit")
    )
    route = F.when(reason.isNotNull(), "reject").when(F.col("file_name").endswith(".zip"), "archive").otherwise("file")
    return uploads.withColumns({"route": route, "reject_reason": reason})


def uploaded_sources(uploads: DataFrame, preset: str = "default") -> DataFrame:
    """(job_id, path, content) of all uploads that are let in (job_id, file_name, length, content binary): a single file as it is, of an
    archive the entries a tree scan would keep."""
    archives = route_uploads(uploads).where(F.col("route") == "archive")
    expanded = archive_sources(archives.select(F.col("job_id").alias("archive"), "content"), preset)
    return upload_sources(uploads).unionByName(expanded)


def upload_sources(uploads: DataFrame) -> DataFrame:
    """(job_id, path, content) of the single-file uploads; archives go through ``archive_sources``, see ``uploaded_sources``."""
    routed = route_uploads(uploads).where(F.col("route") == "file")
    return routed.select("job_id", F.col("file_name").alias("path"), F.col("content").cast("string").alias("content"))
