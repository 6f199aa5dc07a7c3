"""Every query of the library against its SQL in DuckDB, whole tables of the smallest scale."""

import pytest
from check import compare
from conftest import SF

from __spark_entry__ import entry, oracle_sql, queries
from ambersift.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    why, _rows = compare(spark, duck, QUERIES[name], ORACLES.get(name), SF)
    assert not why, why


def test_every_query_has_sql():
    assert sorted(QUERIES) == sorted(ORACLES)
    assert set(QUERIES) <= set(queries()) and set(ORACLES) <= set(oracle_sql())


def test_entry(spark):
    df = entry(spark)
    assert {"product_id", "score", "grade"} <= set(df.columns)
    assert df.limit(1).count() == 1
