"""Pages: the rows that a sort with an offset gives, without one."""

import random

import pytest
from pyspark.sql import functions as F

from ambersift.operators import dashboard
from ambersift.operators.paging import Paged, next_page


@pytest.fixture(scope="module")
def rows(spark):
    rnd = random.Random(6)
    made = [(i, rnd.choice("abc"), rnd.randrange(40)) for i in range(3000)]
    return made, spark.createDataFrame(made, "id int, kind string, n int").repartition(5)


@pytest.mark.parametrize("slices", [1, 7])
def test_every_page(rows, slices):
    made, df = rows
    want = [r for r in sorted(made, key=lambda r: (r[1], -r[2], r[0]))]
    pages = Paged(df, [F.col("kind"), F.col("n").desc(), F.col("id")], slices)
    assert pages.rows == 3000
    for offset, limit in [(0, 10), (0, 3000), (1495, 700), (2990, 50), (3000, 5), (9999, 5), (17, 0), (700, 1)]:
        assert [tuple(r) for r in pages.at(offset, limit).collect()] == want[offset : offset + limit]


def test_a_deep_page_reads_its_slice_only(spark, rows):
    _, df = rows
    pages = Paged(df, [F.col("id")], 8)
    page = pages.at(2000, 20)
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(_slice" in plan and "offset" not in plan.lower()
    assert len({r["f"] for r in page.select(F.input_file_name().alias("f")).collect()}) == 1
    assert Paged(df.limit(0), [F.col("id")]).at(0, 10).count() == 0


def test_shallow_and_deep_agree(rows):
    _, df = rows
    order = [F.col("n"), F.col("id")]
    for page in (0, 3, 60):
        a, b = (dashboard.paginate(df, order, page, 37, shallow).collect() for shallow in (0, 10**9))
        assert a == b


def test_next_page_walks_the_table(rows):
    made, df = rows
    seen, last = [], None
    for _ in range(6):
        page = next_page(df, [("n", True), ("id", False)], last, 100).collect()
        seen += [tuple(r) for r in page]
        last = page[-1].asDict()
    assert seen == sorted(made, key=lambda r: (-r[2], r[0]))[:600]
    assert next_page(df, [("id", False)], {"id": 2999}, 5).count() == 0
