"""Ranks, running totals and previous rows that hold up for a hot group.

A window partitioned by product, project or class code sorts a whole group in
one task. Here rows are range-partitioned by (group, order) instead, so a group
that holds a third of the table is spread over many slices. The slices are
written once to the shared folder: the range bounds come from a sample, and two
branches that sampled for themselves, or a recomputed one, could disagree.
Per-slice results are then shifted by what the earlier slices of the group hold,
a table with one row per (group, slice).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import slice_count, written

_SLICE, _POS = "_slice", "_pos"


def ordered_slices(df: DataFrame, group: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """``df`` plus ``_slice`` and ``_pos`` (place within the slice)."""
    keys = [F.col(g) for g in group] + list(order)
    laid = df.repartitionByRange(slice_count(df.sparkSession), *keys).sortWithinPartitions(*keys)
    # The id holds the partition above bit 33 and the row's place in it below.
    spot = F.monotonically_increasing_id()
    out = laid.withColumn(_POS, spot)
    out = out.withColumn(_SLICE, F.shiftright(F.col(_POS), 33).cast("int"))
    return written(out.withColumn(_POS, F.col(_POS).bitwiseAND(F.lit((1 << 33) - 1))))


def _attach(rows: DataFrame, carry: DataFrame, group: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Put the per-(group, slice) ``values`` of ``carry`` next to every row."""
    right = carry.select(*[F.col(g).alias(f"_grp{i}") for i, g in enumerate(group)], F.col(_SLICE).alias("_at_slice"), *values)
    cond = rows[_SLICE] == right["_at_slice"]
    for i, g in enumerate(group):
        cond = cond & rows[g].eqNullSafe(right[f"_grp{i}"])
    return rows.join(right, cond, "left").drop("_at_slice", *[f"_grp{i}" for i in range(len(group))])


def _earlier(group: Sequence[str]):
    return Window.partitionBy(*group).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)


def _earlier_slices(group: Sequence[str]):
    # Without a group the window covers one row per slice, never the table.
    return _earlier(group) if group else _earlier([F.lit(0)])


def rank_within(df: DataFrame, group: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Exact ``row_number`` (from 1) of a total order within each group."""
    rows = ordered_slices(df, group, order)
    sizes = rows.groupBy(*group, _SLICE).agg(F.count(F.lit(1)).alias("_n"), F.min(_POS).alias("_first"))
    sizes = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(_earlier_slices(group)), F.lit(0)))
    # Written, so that its own size decides how it is joined: if it is small, no row is shuffled.
    out = _attach(rows, written(sizes.drop("_n")), group, ["_first", "_before"])
    rank = F.col(_POS) - F.col("_first") + F.col("_before") + 1
    return out.withColumn(name, rank.cast("long")).drop(_POS, _SLICE, "_first", "_before")


def running_within(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], value: Column, total: str, count: str
) -> DataFrame:
    """Running sum and count of ``value`` up to each row."""
    rows = ordered_slices(df.withColumn("_v", value), group, order)
    upto = Window.partitionBy(*group, _SLICE).orderBy(_POS).rowsBetween(Window.unboundedPreceding, 0)
    sums = rows.groupBy(*group, _SLICE).agg(F.sum("_v").alias("_sv"), F.count("_v").alias("_sc"))
    before = _earlier_slices(group)
    sums = sums.withColumn("_bv", F.coalesce(F.sum("_sv").over(before), F.lit(0))).withColumn(
        "_bc", F.coalesce(F.sum("_sc").over(before), F.lit(0))
    )
    rows = rows.withColumn(total, F.sum("_v").over(upto)).withColumn(count, F.count("_v").over(upto))
    out = _attach(rows, sums, group, ["_bv", "_bc"])
    return (
        out.withColumn(total, F.col(total) + F.col("_bv"))
        .withColumn(count, F.col(count) + F.col("_bc"))
        .drop(_POS, _SLICE, "_bv", "_bc", "_v")
    )


def lag_within(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], value: Column, name: str
) -> DataFrame:
    """``value`` of the previous row of the group, null on its first row."""
    rows = ordered_slices(df.withColumn("_v", value), group, order)
    inside = Window.partitionBy(*group, _SLICE).orderBy(_POS)
    tails = rows.groupBy(*group, _SLICE).agg(F.max(F.struct(_POS, "_v")).alias("_tail"))
    tails = tails.withColumn("_prev", F.last("_tail").over(_earlier_slices(group)))
    rows = rows.withColumn(name, F.lag("_v").over(inside)).withColumn("_at", F.lag(_POS).over(inside))
    out = _attach(rows, tails, group, ["_prev"])
    carried = F.when(F.col("_at").isNull(), F.col("_prev")["_v"]).otherwise(F.col(name))
    return out.withColumn(name, carried).drop(_POS, _SLICE, "_prev", "_at", "_v")


def running_max_within(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], value: Column, name: str
) -> DataFrame:
    """Largest ``value`` up to each row (nulls ignored)."""
    rows = ordered_slices(df.withColumn("_v", value), group, order)
    upto = Window.partitionBy(*group, _SLICE).orderBy(_POS).rowsBetween(Window.unboundedPreceding, 0)
    tops = rows.groupBy(*group, _SLICE).agg(F.max("_v").alias("_top"))
    tops = tops.withColumn("_carry", F.max("_top").over(_earlier_slices(group)))
    out = _attach(rows.withColumn(name, F.max("_v").over(upto)), tops, group, ["_carry"])
    return out.withColumn(name, F.greatest(name, "_carry")).drop(_POS, _SLICE, "_carry", "_v")
