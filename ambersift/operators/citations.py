"""Texts that a small table cites, found without moving the corpus.

The cited keys become a bit table of a fixed size, built by an aggregate and broadcast:
4 MB at most, whatever the number of keys. Files whose key's bit is not set are dropped
where they are read; what a later join shuffles are the cited files and, if there are
very many keys, a few others, never the corpus for a handful of keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY_BITS = 25
_WORD = 1 << 15  # bits of one bitmap of Spark's bitmap aggregate


def _place(on: Sequence[Column]) -> Column:
    return F.pmod(F.xxhash64(*on), F.lit(1 << KEY_BITS))


def cited_only(files: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    """``files`` (columns as they are) whose ``on`` columns may be in ``keys``: every file
    that is, and hardly any other. Null keys cite nothing."""
    place = _place([F.col(c) for c in on])
    wanted = keys.select(*on).dropna().select(place.alias("_place"))
    table = wanted.groupBy(F.floor(F.col("_place") / _WORD).cast("int").alias("_at")).agg(
        F.bitmap_construct_agg(F.pmod("_place", F.lit(_WORD))).alias("_bits")
    )
    rows = files.withColumn("_place", place).withColumn("_at", F.floor(F.col("_place") / _WORD).cast("int"))
    bit = F.pmod("_place", F.lit(_WORD)).cast("int")
    byte = F.conv(F.hex(F.substr(F.col("_bits"), F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    held = rows.join(F.broadcast(table), "_at").filter(F.getbit(byte, F.pmod(bit, F.lit(8))) == 1)
    return held.select(*files.columns)
