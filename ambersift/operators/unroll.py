"""Rows of arrays that are made from texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unrolled(rows: DataFrame, keep: Sequence[str], array: Column | str, name: str) -> DataFrame:
    """``keep`` and one row per element of ``array``, whose elements are never null; none for
    a null or empty array.

    A plain explode is preceded by a filter on its array that the optimizer moves down to the
    scan, below the columns the array is made from: texts and searches are then worked out
    again for every mention of them. The filter of an outer one stays behind it."""
    return rows.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())
