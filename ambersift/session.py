"""Session settings and the shared folder for tables that cut lineage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "ambersift", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators count on (AQE, skew joins, UTC)."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    A cluster must name one that every executor reaches. Only a local session
    (tests, bench) that names none gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="ambersift-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage, survives executor loss, and keeps column pruning and file
    statistics for the plans built on top (a checkpointed RDD would lose both).
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/ambersift-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, keys: Sequence[str], name: str, buckets: int) -> DataFrame:
    """Append ``df`` to the table ``name`` in the shared folder, laid out by ``keys``, and read
    the whole table. Joins and groups on the keys need no exchange on its side."""
    spark = df.sparkSession
    out = df.repartition(buckets, *keys).write.format("parquet").mode("append").bucketBy(buckets, *keys).sortBy(*keys)
    out.option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    spark.catalog.refreshTable(name)
    return spark.table(name)


def slice_count(spark: SparkSession) -> int:
    """Partitions of an explicit range layout: what shuffles start with here."""
    first = spark.conf.get("spark.sql.adaptive.coalescePartitions.initialPartitionNum", None)
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(first or 0))
