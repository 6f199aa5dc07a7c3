"""Benchmark items at the full edit budget, wherever the edits are."""

import random

import numpy as np

from ambersift.llm import decontaminate

from .conftest import frame, sentence
from .oracle import infix_edits


def leaks(spark, items, rows, **how):
    """Found pairs, each checked against brute force, and all pairs that brute force finds."""
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.find_items(frame(spark, rows), bench, **how).collect()}
    want = {}
    for i, text in rows:
        for k, item in items:
            d = infix_edits(item.split(), text.split())
            if d <= decontaminate.allowed(len(item.split()), 0.2):
                want[i, k] = d
    assert all(got[x] >= want[x] for x in got)
    return set(got), set(want)


def test_missing_blocks_and_edits_at_both_ends(spark):
    rng = random.Random(3)
    items = [(i, sentence(rng, n)) for i, n in enumerate([35, 40, 59, 100] * 3)]
    rows = []
    for k, item in items:
        w, e = item.split(), decontaminate.allowed(len(item.split()), 0.2)
        a = rng.randint(1, len(w) - e - 1)
        ends = [f"x{j}" if j < e - 1 and j % 2 == 0 or len(w) - j <= e - 1 and (len(w) - j) % 2 else x for j, x in enumerate(w)]
        for j, passage in enumerate((w[:a] + w[a + e :], ends, w[:a] + ["new"] * e + w[a:])):
            rows.append((10 * k + j, f"{sentence(rng, 40)} {' '.join(passage)} {sentence(rng, 40)}"))
    got, want = leaks(spark, items, rows)
    assert len(want) == len(rows) and got == want


def test_shortened_items_at_the_ends_of_texts(spark):
    rng = random.Random(5)
    items = [(i, sentence(rng, n)) for i, n in enumerate([5, 10, 20, 40, 59] * 3)]
    rows = []
    for k, item in items:
        w, e = item.split(), decontaminate.allowed(len(item.split()), 0.2)
        gone = set(rng.sample(range(len(w)), e))
        some = [x for j, x in enumerate(w) if j not in gone]
        for j, passage in enumerate((w[1:], w[:-1], w[e:], w[:-e], some)):
            own, more = " ".join(passage), sentence(rng, 30)
            for m, text in enumerate((own, f"{own} {more}", f"{more} {own}")):
                rows.append((100 * k + 10 * j + m, text))
    got, want = leaks(spark, items, rows)
    assert len(want) == len(rows) and len(got) >= 0.98 * len(want)
    short = {100 * k + 10 * j for k, _ in items for j in range(4)}  # texts that are all of an item but for one end
    assert {x for x in want if x[0] in short} <= got


def test_items_inside_items(spark):
    rng = random.Random(6)
    items, rows = [], []
    for k in range(8):
        w = sentence(rng, 50).split()
        parts = (w, w[:30], w[10:40], w[20:], w[2:-2], w[15:25])
        items += [(10 * k + j, " ".join(x)) for j, x in enumerate(parts)]
        rows += [(2 * k, f"{sentence(rng, 40)} {' '.join(w)} {sentence(rng, 40)}"), (2 * k + 1, " ".join(w))]
    got, want = leaks(spark, items, rows)
    assert len(want) >= len(rows) * 6 and got == want


def test_many_items(spark, monkeypatch):
    """A bit table that is full or one that grows, and one slice of items or several."""
    rng = random.Random(7)
    items = [(i, sentence(rng, 40)) for i in range(60)]
    rows = [(i, f"{sentence(rng, 50)} {item} {sentence(rng, 50)}") for i, item in items]
    for bits, n in ((4, 1 << 22), (22, 500)):
        monkeypatch.setattr(decontaminate, "TABLE_BITS", bits)
        monkeypatch.setattr(decontaminate, "SLICE", n)
        got, want = leaks(spark, items, rows)
        assert got == want == {(i, i) for i, _ in items}
    rng = np.random.default_rng(0)
    gram = rng.integers(0, 1 << 63, 600_000, dtype=np.uint64) * np.uint64(2)
    places = decontaminate.Places(gram, np.full(len(gram), 40), np.arange(len(gram)) % 38, 3, 0.2)
    assert np.unpackbits(places.packed).mean() <= 1 / 16


def test_recall_at_the_full_budget(spark):
    rng = random.Random(8)
    items = [(i, sentence(rng, 100)) for i in range(150)]
    rows = []
    for k, item in items:
        gone = set(rng.sample(range(100), 20))
        kept = " ".join(x for j, x in enumerate(item.split()) if j not in gone)
        rows.append((k, f"{sentence(rng, 60)} {kept} {sentence(rng, 60)}"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_items(frame(spark, rows), bench).collect()}
    assert got <= {(i, i) for i in range(150)} and len(got) >= 0.98 * 150
