"""Toxicity, language model and decontamination: brute force, held-out accuracy, recall."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from conftest import SF

from ambersift.llm import decontaminate, ngram_lm, queries, toxicity
from ambersift.llm.elias_fano import EliasFano

from .conftest import awkward_rows, frame, sentence
from .oracle import LOWER, PLAIN, infix_edits, words

BAD = ["vorkel", "vorkelan", "vorkelous", "brimsy", "brimsed"]


def labelled(rng, n):
    for _ in range(n):
        toxic = rng.random() < 0.3
        w = sentence(rng, rng.randint(20, 120)).split()
        if toxic:
            for _ in range(max(2, len(w) // 25)):
                w.insert(rng.randrange(len(w)), rng.choice(BAD))
        yield " ".join(w), int(toxic)


def test_toxicity_on_unseen_texts():
    rng = random.Random(1)
    texts, labels = zip(*labelled(rng, 1200))
    model = toxicity.fit(pa.array(texts[:800]), np.array(labels[:800]))
    p = toxicity.sigmoid(model.logits(pa.array(texts[800:])))
    y = np.array(labels[800:])
    assert ((p >= 0.7) == y).mean() > 0.98 and (p[y == 0] < 0.7).mean() > 0.99


def test_identity_terms_lose_their_weight():
    """A group name that stands more often in toxic texts alone makes no text toxic."""
    rng = random.Random(2)
    texts, labels = [], []
    for t, y in labelled(rng, 1000):
        if rng.random() < (0.8 if y else 0.1):
            t = f"{t} the muslim woman"
        elif rng.random() < 0.5:
            t = f"{t} the christian man"
        texts.append(t)
        labels.append(y)
    neutral = pa.array([f"{sentence(rng, 25)} a muslim neighbour came" for _ in range(200)])
    swapped = pa.array([t.replace("muslim", "christian") for t in neutral.to_pylist()])
    gap, wrong = [], []
    for pairing in (0.0, 1.0):
        model = toxicity.fit(pa.array(texts), np.array(labels), pairing=pairing)
        gap.append(float(abs(model.logits(neutral) - model.logits(swapped)).mean()))
        wrong.append(float((toxicity.sigmoid(model.logits(neutral)) >= 0.7).mean()))
    assert gap[0] > 2 and gap[1] < 0.1  # the change of the logit under a swap
    assert wrong[1] <= wrong[0] and wrong[1] == 0


def test_toxicity_awkward(spark, awkward, no_rows):
    labels = spark.createDataFrame([(5, 1), (8, 0), (9, 0), (None, 1), (11, None), (99, 1)], "doc_id long, toxic int")
    model = toxicity.learn(awkward, labels)
    rows = toxicity.score(awkward, model).collect()
    assert len(rows) == awkward.count()
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert len({r.score for r in rows if r.doc_id in (1, 2, 3)}) == 1
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows if r.doc_id is not None)
    out = toxicity.drop_toxic(awkward, model)
    assert out.columns == awkward.columns
    nothing = toxicity.learn(no_rows, labels.limit(0))
    assert toxicity.score(awkward, nothing).agg({"predicted": "max"}).first()[0] == 0
    assert toxicity.score(no_rows, nothing).count() == 0


def brute_model(texts, discount=0.75):
    one, two, three = Counter(), Counter(), Counter()
    for t in texts:
        w = words((t or "").translate(LOWER)) + [None]
        one.update(w)
        two.update(zip(w, w[1:]))
        three.update(zip(w, w[1:], w[2:]))
    total, size = sum(one.values()), len(one)
    two, three = ({k: c for k, c in n.items() if c >= 2} for n in (two, three))
    left2, left3 = Counter(), Counter()
    for (u, _), c in two.items():
        left2[u] += c - discount
    for (u, v, _), c in three.items():
        left3[u, v] += c - discount

    def p(k, w):
        x = w[k]
        out = (one[x] + 0.5) / (total + 0.5 * (size + 1))
        if k >= 1 and one[w[k - 1]]:
            v = w[k - 1]
            out = max(0, two.get((v, x), 0) - discount) / one[v] + (1 - left2[v] / one[v]) * out
            if k >= 2 and (w[k - 2], v) in two:
                uv = (w[k - 2], v)
                out = max(0, three.get((*uv, x), 0) - discount) / two[uv] + (1 - left3[uv] / two[uv]) * out
        return out

    return one, total, size, p


@pytest.mark.parametrize("shard_entries", [1 << 19, 64])
def test_language_model(spark, monkeypatch, shard_entries):
    """The second run cuts the trie into many shards."""
    monkeypatch.setattr(ngram_lm, "SHARD_ENTRIES", shard_entries)
    rng = random.Random(3)
    common = [sentence(rng, 12) for _ in range(30)]
    rows = [(i, ". ".join(rng.choice(common) for _ in range(rng.randint(0, 12))) + " " + sentence(rng, 5)) for i in range(200)]
    rows += [(300, None), (301, ""), (302, "THE the The"), (303, "x" * 100_000)]
    got = {r.doc_id: r for r in ngram_lm.score_held_out(frame(spark, rows)).collect()}
    train = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1]
    one, total, size, p = brute_model(train)
    for i, t in rows:
        w = words((t or "").translate(LOWER)) + [None]
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(one[x] > 0 for x in w), total)
        assert r.base_score == pytest.approx(sum(math.log10((one[x] + 0.5) / (total + 0.5 * (size + 1))) for x in w))
        assert abs(r.score - sum(math.log10(p(k, w)) for k in range(len(w)))) < 3e-4 * len(w)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > 0.7 * sum(r.base_score for r in held)


def test_language_model_awkward(awkward, no_rows):
    rows = ngram_lm.score_held_out(awkward).collect()
    assert len(rows) == len(awkward_rows()) and all(r.score <= 0 and r.n_tokens >= 1 for r in rows)
    assert ngram_lm.score_held_out(no_rows).count() == 0


@pytest.mark.parametrize("n, universe", [(0, 10), (1, 1), (5, 6), (1000, 1 << 40), (50_000, 1 << 62), (1000, 1000)])
def test_elias_fano(n, universe):
    rng = np.random.default_rng(n)
    v = np.unique(rng.integers(0, universe, n, dtype=np.uint64))
    ef = EliasFano.build(v, universe)
    assert (ef.value(np.arange(len(v))) == v).all()
    x = np.concatenate([v, rng.integers(0, universe, 500, dtype=np.uint64)])
    place = {int(k): i for i, k in enumerate(v)}
    assert ef.find(x).tolist() == [place.get(int(k), -1) for k in x]


def edited(rng, w, edits):
    w = list(w)
    for _ in range(edits):
        at, kind = rng.randrange(len(w)), rng.choice("sid")
        if kind == "s":
            w[at] = "changed"
        elif kind == "i":
            w.insert(at, "added")
        else:
            del w[at]
    return w


def test_decontamination_recall(spark):
    rng = random.Random(11)
    items = [(i, sentence(rng, rng.randint(12, 60))) for i in range(40)] + [(40, "too short"), (41, None), (42, "")]
    rows, planted = [], set()
    for i in range(400):
        body = sentence(rng, rng.randint(0, 150))
        if i % 2 == 0:
            k = rng.randrange(40)
            w = items[k][1].split()
            part = edited(rng, w, rng.randint(0, decontaminate.allowed(len(w), 0.2)))
            body = f"{body} {' '.join(part).upper()}, {sentence(rng, 30)}"
            planted.add((i, k))
        rows.append((i, body))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.edits for r in decontaminate.find_items(frame(spark, rows), bench).collect()}
    texts, want = dict(rows), {}
    for i, k in {*planted, *got}:
        item = PLAIN.findall(items[k][1].lower())
        d = infix_edits(item, PLAIN.findall(texts[i].lower()))
        if d <= decontaminate.allowed(len(item), 0.2):
            want[i, k] = d
    assert set(got) <= set(want)  # verified: nothing clean is reported
    assert len(got) >= 0.95 * len(want) and planted <= set(want)
    exact = {x for x in want if want[x] == 0}
    assert exact and exact <= set(got)
    assert all(got[x] == want[x] for x in exact)


def test_decontamination_awkward(spark, awkward, no_rows):
    bench = spark.createDataFrame([(1, awkward_rows()[7][1]), (2, awkward_rows()[7][1]), (None, None)], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontaminate.find_items(awkward, bench).collect()}
    assert found == {(8, 1), (9, 1), (10, 1), (None, 1), (11, 1), (12, 1)}
    out = decontaminate.drop_contaminated(awkward, bench)
    assert out.columns == awkward.columns
    assert sorted(str(r.doc_id) for r in out.select("doc_id").collect()) == sorted(
        str(i) for i, t in awkward_rows() if i not in (8, 9, 10, 11, 12) and (i is not None or t is None)
    )
    assert decontaminate.find_items(no_rows, bench).count() == 0
    assert decontaminate.find_items(awkward, bench.limit(0)).count() == 0


def test_every_operator_has_a_query(spark):
    numbers = sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES)
    assert numbers == list(range(1, 11))
    assert queries.QUERIES["op4_toxicity"](spark, SF).count() == 200


def test_counts_of_sorted_parts_are_merged():
    """Rows of equal keys met twice, once in a task's sort and once before the shuffle."""
    draw = np.random.default_rng(3)
    for keys in (1, 2):
        parts = []
        for n in (0, 400, 1, 300):
            rows, counts = np.unique(draw.integers(0, 12, (n, keys)).astype(np.uint64) + np.uint64((1 << 31) - 6), axis=0, return_counts=True)
            parts.append((*(rows[:, k] if k else rows[:, k] << np.uint64(32) for k in range(keys)), counts))
        want = {}
        for part in parts:
            for row in zip(*(c.tolist() for c in part)):
                want[row[:-1]] = want.get(row[:-1], 0) + row[-1]
        for some in (parts, parts[:1], parts[1:2]):
            got = ngram_lm._merged(some)
            assert len(got) == keys + 1 and [*zip(*(c.tolist() for c in got[:-1]))] == sorted({r for p in some for r in zip(*(c.tolist() for c in p[:-1]))})
        assert {row[:-1]: row[-1] for row in zip(*(c.tolist() for c in ngram_lm._merged(parts)))} == want
    assert np.array_equal(ngram_lm.decode(np.arange(1 << 16, dtype=np.uint16)), 10.0 ** (-ngram_lm.GRID * np.arange(1 << 16)))


def test_counted_rows_are_shuffled_as_they_come(spark):
    """A second sum before the shuffle cost as much as the one behind it and found little."""
    def one():
        return lambda column: iter([(np.array([1, 2], np.uint64), np.array([1, 1]))])

    rows = ngram_lm._counted(spark.createDataFrame([("a",), ("b",)], "text string").repartition(2), ["h"], one)
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.index("HashAggregate") < plan.rindex("HashAggregate") < plan.index("hashpartitioning(h")
    assert sorted(map(tuple, rows.collect())) == [(1, 2), (2, 2)]
