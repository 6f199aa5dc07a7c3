"""Pages at any depth, and pages after a known row.

A sort with an offset brings all rows before the page to one task. For deep pages the rows
are laid out once in sorted slices, each in a folder of its own; how many rows each slice
has is an index of a few thousand numbers, and a page reads the slices that hold it and no
other. For tables that change between pages there is ``next_page``, which takes the last
row seen instead of a number.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections.abc import Mapping, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import any_of
from ..session import shared_dir, slice_count

#: Rows before a page that one task may pass over.
SHALLOW = 10_000
_SLICE, _POS = "_slice", "_pos"


class Paged:
    """The rows of ``df`` in ``order`` (a total order), ready for pages."""

    def __init__(self, df: DataFrame, order: Sequence[Column], slices: int | None = None):
        spark = df.sparkSession
        self.columns = df.columns
        laid = df.repartitionByRange(slices or slice_count(spark), *order).sortWithinPartitions(*order)
        spot = F.monotonically_increasing_id()
        # The id holds the partition above bit 33 and the row's place in it below.
        laid = laid.withColumn(_POS, spot).withColumn(_SLICE, F.shiftright(F.col(_POS), 33).cast("int"))
        laid = laid.withColumn(_POS, F.col(_POS).bitwiseAND(F.lit((1 << 33) - 1)))
        path = f"{shared_dir(spark)}/pages-{uuid.uuid4().hex}"
        laid.write.partitionBy(_SLICE).parquet(path)
        self.table = spark.read.schema(laid.schema).parquet(path)
        sizes = sorted(self.table.groupBy(_SLICE).agg(F.count(F.lit(1)).alias("n")).collect())
        self.slices = [r[_SLICE] for r in sizes]
        #: Rows before each slice, and all rows at the end.
        self.before = [0, *accumulate(r["n"] for r in sizes)]

    @property
    def rows(self) -> int:
        return self.before[-1]

    def at(self, offset: int, limit: int) -> DataFrame:
        """Rows ``offset`` to ``offset + limit - 1``, in order; fewer at the end."""
        end = min(offset + limit, self.rows)
        k, wanted = bisect_right(self.before, offset) - 1, []
        while offset < end and k < len(self.slices) and self.before[k] < end:
            first, last = max(offset - self.before[k], 0), min(end, self.before[k + 1]) - self.before[k] - 1
            wanted.append((F.col(_SLICE) == self.slices[k]) & F.col(_POS).between(first, last))
            k += 1
        return self.table.filter(any_of(wanted)).orderBy(_SLICE, _POS).select(*self.columns)


def rows_from(df: DataFrame, order: Sequence[Column], offset: int, limit: int, shallow: int = SHALLOW) -> DataFrame:
    """``limit`` rows from row ``offset`` on. Near the front by a sort with a limit, farther
    back by slices; the rows are the same."""
    if offset <= shallow:
        return df.orderBy(*order).offset(offset).limit(limit)
    return Paged(df, order).at(offset, limit)


def next_page(df: DataFrame, order: Sequence[tuple[str, bool]], last: Mapping | None, limit: int) -> DataFrame:
    """The ``limit`` rows that follow the row ``last`` (its order columns by name; None: from
    the front) by ``order``, pairs of (column, descending) whose columns hold no nulls. What
    lies before is filtered where it is read, and rows that were added or removed there
    since do not shift the page."""
    if last is not None:
        steps, same = [], F.lit(True)
        for name, desc in order:
            value = F.lit(last[name])
            steps.append(same & ((F.col(name) < value) if desc else (F.col(name) > value)))
            same = same & (F.col(name) == value)
        df = df.filter(any_of(steps))
    return df.orderBy(*[F.col(n).desc() if desc else F.col(n).asc() for n, desc in order]).limit(limit)
