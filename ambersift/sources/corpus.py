"""Text corpora from file trees or tables, with the walk's exclusions as filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import base_name, extension, in_any_dir
from ..functions.text import any_of, first_where

# What a corpus leaves out.
IGNORE_DIRS = (
    ".git", "node_modules", "venv", ".venv", "__pycache__", ".next", "dist", "build", ".nuxt", "vendor",
)
IGNORE_EXTS = (
    ".png", ".jpg", ".jpeg", ".gif", ".ico", ".mp4", ".webm", ".mp3", ".wav", ".pdf", ".zip", ".tar", ".gz",
    ".exe", ".dll", ".so", ".dylib", ".pyc", ".class",
)
BUNDLE_SHAPE = r"\.min\.js\z|\.min\.css\z|\.bundle\.|swagger-ui|redoc\.standalone"
MAX_FILE_BYTES, MAX_REPORT_BYTES, HEAD_CHARS = 10 * 1024 * 1024, 5 * 1024 * 1024, 512
REPORT_MARKER = "<!-- generated-report -->"
REPORT_PREFIX = "scan-report-"


def path_reason(path: Column, ignore_paths: Sequence[str] = (), report_prefix: str = REPORT_PREFIX) -> Column:
    """Why a path is left out (ignored folder or kind, minified or bundled, a report, an own
    exclusion), or null."""
    base = F.lower(base_name(path))
    report = F.startswith(base, F.lit(report_prefix)) & F.endswith(base, F.lit(".md"))
    own = any_of([F.contains(path, F.lit(p.strip("/"))) for p in ignore_paths if p.strip("/")])
    return first_where(
        [
            (in_any_dir(path, IGNORE_DIRS), "ignored folder"),
            (extension(path).isin(*IGNORE_EXTS), "ignored kind"),
            (F.rlike(base, F.lit(BUNDLE_SHAPE)), "bundle"),
            (report, "report"),
            (own, "excluded"),
        ]
    )


def content_reason(
    path: Column, head: Column, size: Column, marker: str = REPORT_MARKER, max_bytes: int = MAX_FILE_BYTES,
    max_report_bytes: int = MAX_REPORT_BYTES,
) -> Column:
    """Why a file's size or head leaves it out (too large, a NUL character, a generated
    report by its marker), or null."""
    report = (
        extension(path).isin(".md", ".markdown") & (size > 0) & (size < max_report_bytes)
        & F.contains(head, F.lit(marker))
    )
    return first_where(
        [(size > max_bytes, "too large"), (F.contains(head, F.lit("\x00")), "binary"), (report, "report")]
    )


def with_skip_reason(
    files: DataFrame, ignore_paths: Sequence[str] = (), marker: str = REPORT_MARKER, max_bytes: int = MAX_FILE_BYTES,
    head_chars: int = HEAD_CHARS, report_prefix: str = REPORT_PREFIX,
) -> DataFrame:
    """A table of (project, path, content, ..) with ``skipped``, null for files of the corpus."""
    path, content = F.col("path"), F.col("content")
    why = content_reason(path, F.left(content, F.lit(head_chars)), F.octet_length(content), marker, max_bytes)
    return files.withColumn("skipped", F.coalesce(path_reason(path, ignore_paths, report_prefix), why))


def corpus_filter(files: DataFrame, ignore_paths: Sequence[str] = (), marker: str = REPORT_MARKER, **limits) -> DataFrame:
    """The exclusions over a table of (project, path, content)."""
    return with_skip_reason(files, ignore_paths, marker, **limits).filter(F.col("skipped").isNull()).drop("skipped")


def skipped_files(files: DataFrame, ignore_paths: Sequence[str] = (), marker: str = REPORT_MARKER, **limits) -> DataFrame:
    """What the corpus leaves out, with the reason: no file disappears without a trace."""
    rows = with_skip_reason(files, ignore_paths, marker, **limits).filter(F.col("skipped").isNotNull())
    return rows.select(*[c for c in files.columns if c != "content"], "skipped")


def read_tree(spark: SparkSession, root: str, project: str | None = None, max_bytes: int | None = None) -> DataFrame:
    """A tree of files as (project, path, content), nothing left out but files beyond
    ``max_bytes``, whose bytes are then not read. The project is the first folder below
    ``root`` unless one is given."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    if max_bytes is not None:
        raw = raw.filter(F.col("length") <= max_bytes)
    clean = root.rstrip("/").split(":", 1)[-1]
    rel = F.substr(F.col("path"), F.instr(F.col("path"), clean) + len(clean) + 1)
    text = F.col("content").cast("string")
    files = raw.select(rel.alias("path"), F.coalesce(F.try_validate_utf8(text), F.make_valid_utf8(text)).alias("content"))
    if project is not None:
        return files.select(F.lit(project).alias("project"), "path", "content")
    return files.select(
        F.substring_index("path", "/", 1).alias("project"), F.regexp_replace("path", r"^[^/]*/", "").alias("path"), "content"
    )


def read_corpus(
    spark: SparkSession, root: str, ignore_paths: Sequence[str] = (), marker: str = REPORT_MARKER,
    project: str | None = None, max_bytes: int = MAX_FILE_BYTES,
) -> DataFrame:
    """A tree of text files as (project, path, content), the exclusions applied.

    The size limit is pushed into the reader; paths are judged on rows, after the bytes
    of a file have been read, so a tree that is scanned often should be landed as a table
    once. ``skipped_files(read_tree(..))`` tells what is left out and why."""
    return corpus_filter(read_tree(spark, root, project, max_bytes), ignore_paths, marker, max_bytes=max_bytes)
