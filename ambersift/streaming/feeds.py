"""Finding and telemetry feeds: first findings, running totals, windowed counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import norm_upper
from ..operators.merge import fingerprint


def event_time(df: DataFrame, name: str) -> DataFrame:
    """Watermarks need a zoned timestamp; a plain one is read in the session's zone."""
    return df.withColumn(name, F.col(name).cast("timestamp"))


def stream_dedup(findings: DataFrame, at: str = "created_at", late: str = "1 day") -> DataFrame:
    """First finding per fingerprint within the watermark."""
    keyed = findings.withColumn("fingerprint", fingerprint())
    return event_time(keyed, at).withWatermark(at, late).dropDuplicatesWithinWatermark(["fingerprint"])


def running_telemetry(metrics: DataFrame) -> DataFrame:
    """Running totals and mean score per project; in update mode a batch writes the projects it touched."""
    return metrics.groupBy("project").agg(
        F.count(F.lit(1)).alias("scans"), F.sum("files_scanned").alias("files"),
        F.sum("findings_total").alias("findings"), F.avg("security_score").alias("mean_score"),
    )


def severity_windows(
    findings: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "1 day"
) -> DataFrame:
    """Tumbling or sliding counts per severity; rows later than the watermark are dropped.
    In update mode windows leave the state once the watermark has passed them."""
    rows = event_time(findings, "created_at").withWatermark("created_at", late) if findings.isStreaming else findings
    window = F.window("created_at", size, slide) if slide else F.window("created_at", size)
    out = rows.groupBy(window, norm_upper(F.col("severity")).alias("severity")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("window_start"), "severity", "n")
