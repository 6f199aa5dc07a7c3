import math
import random

import pytest
from pyspark.sql import functions as F

from ambersift.llm.mixture import SCHEDULE, curriculum, integral, training_order, when_reached

from .conftest import frame, sentence
from .oracle import words


def fill(sizes, weights, repeats=3):
    """Targets by the rule itself: what is above a cap is shared anew until nothing is."""
    full, out = set(), [0.0] * len(sizes)
    while True:
        rest = sum(sizes) - sum(repeats * sizes[k] for k in full)
        open_ = [k for k in range(len(sizes)) if k not in full]
        for k in open_:
            out[k] = rest * weights[k] / sum(weights[i] for i in open_)
        above = [k for k in open_ if out[k] > repeats * sizes[k]]
        if not above:
            return out
        for k in above:
            out[k] = float(repeats * sizes[k])
        full |= set(above)


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, source string, text string, place int, size string, copies int")


def mixed(spark, seed, sources):
    rng = random.Random(seed)
    rows = []
    for s, n in sources:
        for _ in range(n):
            rows.append((len(rows) if rng.random() < 0.9 else 7, s, sentence(rng, rng.randint(0, 40)), 1, "x", 2))
    return rows, docs_of(spark, rows)


SETS = [
    [("a", 200), ("b", 3), ("c", 2), ("d", 1)],
    [(None, 5), ("", 6), ("Z", 40), ("z", 1), ("é", 1), ("ﬀ", 1), ("😀", 30)],
    [("only", 9)],
    [(f"s{k}", 1 + k % 4) for k in range(25)],
]


@pytest.mark.parametrize("k", range(len(SETS)))
def test_targets_and_taken_words(spark, k):
    rows, docs = mixed(spark, k, SETS[k])
    got = curriculum(docs).collect()
    assert len(got) == len(rows)
    size = {}
    for _, s, t, *_ in rows:
        size[s] = size.get(s, 0) + len(words(t))
    order = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in size)
    want = dict(zip(order, fill([size[s] for s in order], [1 + i % 3 for i in range(len(order))])))
    taken = {}
    for r in got:
        assert r.source_size == size[r.source]
        assert math.isclose(r.target, want[r.source], rel_tol=1e-12, abs_tol=1e-9)
        assert 0 <= r.taken <= 3 * r.size and r.taken == sum(c.words for c in r.copies)
        assert r.position == (r.copies[0].position if r.copies else None)
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in order:
        assert abs(taken[s] - want[s]) < 1


def test_reruns_agree_and_order_is_that_of_positions(spark):
    rows, docs = mixed(spark, 9, SETS[0])
    one = [tuple(r) for r in curriculum(docs).collect()]
    two = [tuple(r) for r in curriculum(docs.repartition(7)).collect()]
    assert sorted(one, key=repr) == sorted(two, key=repr)
    at = [r[6] for r in one if r[6] is not None]
    assert at == sorted(at) and all(0 <= p <= 1 for p in at)
    seen = training_order(curriculum(docs)).collect()
    assert [r.position for r in seen] == sorted(r.position for r in seen)
    assert sum(r.words for r in seen) == sum(r[5] for r in one)


def test_rates_follow_the_schedule(spark):
    """The words read of a source up to a time are its integral there, within one document."""
    rng = random.Random(3)
    docs = docs_of(spark, [(k, f"s{k % 3}", sentence(rng, 10), 0, "", 0) for k in range(900)])
    seen = training_order(curriculum(docs)).collect()
    for k, knots in enumerate(SCHEDULE):
        mine = [r for r in seen if r.source == f"s{k}"]
        whole = sum(r.words for r in mine)
        for t in (0.1, 0.5, 0.8):
            grid = [(i + 0.5) * t / 2000 for i in range(2000)]
            rate = 0.0
            for x in grid:
                for (a, w), (b, v) in zip(knots, knots[1:]):
                    if a <= x < b:
                        rate += (w + (v - w) * (x - a) / (b - a)) * t / 2000
            assert abs(sum(r.words for r in mine if r.position < t) - whole * rate / integral(knots)[-1]) <= 11


def test_inverse_of_integrals(spark):
    knots = ((0.0, 0.0), (0.25, 4.0), (0.5, 4.0), (1.0, 0.0))
    shares = spark.range(101).select((F.col("id") / 100).alias("u"))
    for r in shares.select("u", when_reached(knots, F.col("u")).alias("t")).collect():
        area = integral(knots)
        x = 2 * r.t**2 * 4 if r.t < 0.25 else area[1] + 4 * (r.t - 0.25) if r.t < 0.5 else area[3] - 4 * (1 - r.t) ** 2
        assert math.isclose(x, r.u * area[-1], abs_tol=1e-9)


def test_bad_schedules(spark, no_rows):
    for knots in (((0.0, 1.0), (0.9, 1.0)), ((0.0, 0.0), (1.0, 0.0)), ((0.0, -1.0), (1.0, 2.0)), ((0.0, 1.0), (0.0, 2.0), (1.0, 1.0))):
        with pytest.raises(ValueError):
            curriculum(no_rows, (knots,))


def test_awkward_rows(spark, awkward, no_rows):
    got = curriculum(awkward).collect()
    assert len(got) == awkward.count() and sum(r.taken for r in got) == got[0].source_size
    assert [r.size for r in got if r.doc_id == 13] == [30_000] and any(r.doc_id is None for r in got)
    assert curriculum(no_rows).count() == 0
    blank = frame(spark, [(1, None), (2, " \n ")])
    assert {(r.doc_id, r.size, r.target, r.taken, r.position) for r in curriculum(blank).collect()} == {
        (1, 0, 0.0, 0, None), (2, 0, 0.0, 0, None)
    }


def test_no_python_in_the_plan(spark, awkward):
    plan = curriculum(awkward)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "rangepartitioning" in plan
