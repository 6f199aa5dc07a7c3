"""File-change feeds: debounced groups and incremental scans."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.paths import base_name
from ..operators.file_checks import changed_files_only
from ..operators.ordering import lag_within, running_max_within
from ..operators.rules import Rule, scan_rules
from .debounce import NO_TIME, OUTPUT, Debounce
from .feeds import event_time

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Operations that count as a change.
CHANGE_OPS = ("write", "create", "rename")
NOISE_NAME = r"^\.|~\z|\.swp\z|\.tmp\z"


def relevant_changes(events: DataFrame) -> DataFrame:
    """Writes, creates and renames of files that are not editor noise."""
    return events.filter(
        F.col("op").isin(*CHANGE_OPS) & ~F.rlike(base_name(F.col("path")), F.lit(NOISE_NAME))
    )


def debounced_changes(
    events: DataFrame, gap_seconds: float = 0.3, late: str = "10 seconds", max_age_seconds: float | None = 3600,
    buckets: int = 512,
) -> DataFrame:
    """Changes of a stream, grouped until a workspace is quiet for ``gap_seconds``: a row
    (workspace, started_at, path, first_change, events) per file, in append mode, once the
    watermark has passed the group. A group that is never quiet ends at ``max_age_seconds``
    (``None``: never); rows later than the watermark are dropped. State lies in RocksDB,
    a key for each of ``buckets`` of workspaces, a number that a checkpoint has to keep; a
    batch reads and writes the open groups of the buckets it touches.
    For tables there is ``debounced_changes_batch``."""
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    rows = event_time(relevant_changes(events), "changed_at").withWatermark("changed_at", late)
    rows = rows.select(
        F.pmod(F.xxhash64("workspace"), F.lit(buckets)).alias("bucket"), "workspace", "path", "changed_at",
        F.coalesce(F.unix_micros("changed_at"), F.lit(NO_TIME)).alias("us"),
    )
    age = None if max_age_seconds is None else int(max_age_seconds * 1_000_000)
    return rows.groupBy("bucket").transformWithStateInPandas(
        Debounce(int(gap_seconds * 1_000_000), age), OUTPUT, "Append", "EventTime"
    )


def _micros(at: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), at)


def debounced_changes_batch(events: DataFrame, gap_seconds: float = 0.3) -> DataFrame:
    """The same groups over a table: (workspace, started_at, path, events) per file.

    Starts of quiet-separated groups come from previous rows and running maxima over
    slices, so a workspace with a third of all events is not one task's work."""
    rows = relevant_changes(events).select(
        "workspace", "path", "event_id", "changed_at", _micros(F.col("changed_at")).alias("_us")
    )
    order = [F.col("_us"), F.col("event_id")]
    rows = lag_within(rows, ["workspace"], order, F.col("_us"), "_before")
    fresh = F.col("_before").isNull() | (F.col("_us") - F.col("_before") >= int(gap_seconds * 1_000_000))
    rows = running_max_within(rows, ["workspace"], order, F.when(fresh, F.col("_us")), "_start")
    return rows.groupBy("workspace", "_start", "path").agg(
        F.min("changed_at").alias("first_change"), F.count(F.lit(1)).alias("events")
    ).withColumn(
        "started_at",
        F.timestamp_add("MICROSECOND", F.col("_start"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")),
    ).drop("_start")


def incremental_scan(
    events: DataFrame, files: DataFrame, rules: Sequence[Rule], sink: Callable[[DataFrame, int], None],
    checkpoint: str, directive: str | None = "scan", trigger: dict | None = None,
) -> StreamingQuery:
    """Per micro-batch, scan the changed files only and hand the hits to ``sink``; texts of
    other files are dropped where they are read. ``trigger``: as Spark takes it, by default
    what is there and then stop; a live watch gives ``{"processingTime": ...}``."""

    def run(batch: DataFrame, epoch: int) -> None:
        changed = relevant_changes(batch).select(F.col("workspace").alias("project"), "path").distinct()
        hits = scan_rules(changed_files_only(files, changed), rules, directive=directive)
        sink(hits, epoch)

    return (
        events.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    )
