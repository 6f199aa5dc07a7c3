"""Tables shared by the queries of this package."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` has it (upper or lower case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def tokenizer(name: str) -> str:
    """Path of a public vocabulary file, as installed on driver and executors."""
    import public_tokenizers

    return public_tokenizers.path(name)


def join_counted(left: DataFrame, right: DataFrame, key: str, n: str, parts: int = 1000, least: int = 10_000) -> DataFrame:
    """Inner join of ``left`` with ``right``, which holds every key once and in ``n`` how
    many rows of ``left`` have it.

    A key that holds more than one part in ``parts`` of the matching rows, and more than
    ``least``, would make a long task. There are fewer than ``parts`` such keys, so they
    are broadcast and their rows stay where they are. All other keys are joined by a
    shuffle. ``right`` is read more than once, and so is ``left`` if there are such keys.
    """
    total, most = right.agg(F.sum(n), F.max(n)).first()
    bound = max((total or 0) / parts, least)
    if (most or 0) <= bound:
        return left.join(right, key)
    hot = F.broadcast(right.filter(F.col(n) > bound))
    cold = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right.filter(F.col(n) <= bound), key)
    return cold.unionByName(left.join(hot, key))
