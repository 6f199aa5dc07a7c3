"""Exact copies, near copies and repeated passages against brute force."""

import hashlib
import random
import re
import sys
from collections import defaultdict
from pathlib import Path

import pytest
from conftest import SF

sys.path.insert(0, str(Path(__file__).parent))

from oracle import near_groups, removed_words  # noqa: E402

from ambersift.llm import exact_dedup, groups, jaccard_join, queries, substring_dedup  # noqa: E402

from .conftest import awkward_rows, frame, sentence  # noqa: E402


def best(rows):
    """By digest: the id that stays and the group's size."""
    held = defaultdict(list)
    for i, t in rows:
        s = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        held[hashlib.sha256(s.encode()).hexdigest()].append((-len(t or ""), i is None, i))
    return {k: (min(v)[2] if len({x[1] for x in v}) == 1 else min(v, key=lambda x: x[:2])[2], len(v)) for k, v in held.items()}


def test_exact_dedup_awkward(awkward):
    rows = exact_dedup.exact_dedup(awkward, fan=2, rounds=3).collect()
    assert len(rows) == len(awkward_rows())
    sizes = {k: n for k, (_, n) in best(awkward_rows()).items()}
    assert {r.text_sha256: r.group_size for r in rows} == sizes
    assert all(sum(r.kept for r in rows if r.text_sha256 == k) == 1 for k in sizes)
    spread = next(r for r in rows if r.doc_id == 10)  # the same words with more blanks: the longest stays
    assert spread.kept and {r.keep_id for r in rows if r.text_sha256 == spread.text_sha256} == {10}


def test_exact_dedup_hot_group(spark):
    rng = random.Random(1)
    texts = [sentence(rng, 20) for _ in range(50)]
    rows = [(i, "hot text" if i % 3 else texts[i % 50]) for i in range(3000)]
    random.Random(2).shuffle(rows)
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(frame(spark, rows), fan=4, rounds=2).collect()}
    want = best(rows)
    for i, t in rows:
        keep, n = want[hashlib.sha256(re.sub(r"\s", "", t).encode()).hexdigest()]
        assert got[i] == (keep, n, keep == i)


def test_exact_dedup_is_native(spark):
    plan = queries.QUERIES["op8_exact_dedup"](spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_drop_copies_keeps_columns(awkward, no_rows):
    out = exact_dedup.drop_copies(awkward)
    assert out.columns == awkward.columns
    assert out.count() == len(best(awkward_rows()))
    assert exact_dedup.drop_copies(no_rows).count() == 0


def family(rng, base, n, edits):
    """``n`` variants of a text with ``edits`` words changed."""
    words = base.split()
    for _ in range(n):
        w = list(words)
        for at in rng.sample(range(len(w)), edits):
            w[at] = f"new{rng.randint(0, 10**6)}"
        yield " ".join(w)


@pytest.fixture(scope="module")
def near_rows():
    rng = random.Random(3)
    texts = [sentence(rng, rng.randint(1, 200)) for _ in range(150)]
    shared = sentence(rng, 40)
    for k in range(8):
        texts += list(family(rng, sentence(rng, 150 + k), 12, 1 + k % 3))
    texts += [f"{shared} {sentence(rng, 60)}" for _ in range(60)]  # a passage in common is not similarity
    texts += texts[:20] + ["", None, "a b", "A B", "a b c d e"]
    texts += list(family(rng, sentence(rng, 220), 60, 2))
    rng.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("limits", [{}, {"limit": 8, "depth": 2}])
def test_near_copies(spark, near_rows, limits):
    """The second run cannot split enough and compares large buckets block by block."""
    got = {r.doc_id: r for r in jaccard_join.similar(frame(spark, near_rows), recall=0.9999, **limits).collect()}
    want = near_groups(dict(near_rows))
    assert len(got) == len(near_rows)
    assert {i: (r.class_id, r.copy_of, r.n_links) for i, r in got.items()} == want
    assert sum(w[2] for w in want.values()) > 500


def test_near_copies_awkward(awkward, no_rows):
    rows = jaccard_join.similar(awkward).collect()
    assert len(rows) == awkward.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert {by_id[i].class_id for i in (8, 9, 10)} == {8} and by_id[13].class_id == 5
    assert by_id[1].class_id == 1 and by_id[3].n_links == 0
    assert all(r.class_id is None for r in rows if r.doc_id is None)
    kept = jaccard_join.drop_near_copies(awkward)
    assert kept.columns == awkward.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {None, 1, 2, 3, 4, 5, 6, 7, 8, 14, 15} | (
        {11, 12} & {i for i in (11, 12) if by_id[i].class_id == i}
    )
    assert jaccard_join.similar(no_rows).count() == 0


def test_recall_of_runs():
    """The chance to lose a pair follows the branching process."""
    assert jaccard_join.loss_per_run(0.8) == pytest.approx(0.0625)
    assert jaccard_join.runs_for(0.8, 0.999) == 3


def test_components_of_chains_and_hubs(spark):
    chain = [(i, i + 1) for i in range(200)]
    hub = [(1000, i) for i in range(1001, 1400)] + [(5000, 5000)]
    edges = spark.createDataFrame(chain + hub, "u long, v long")
    got = {r.node: r.root for r in groups.components(edges).collect()}
    assert len({got[i] for i in range(201)}) == 1 and len({got[i] for i in range(1000, 1400)}) == 1
    assert got[0] != got[1000] and len(got) == 601


@pytest.fixture(scope="module")
def passage_rows():
    rng = random.Random(5)
    rows = [sentence(rng, rng.randint(0, 300)) for _ in range(60)]
    for n in (49, 50, 51, 130):
        passage = sentence(rng, n)
        rows += [f"{sentence(rng, rng.randint(0, 40))}\n{passage}  {sentence(rng, rng.randint(0, 70))}" for _ in range(8)]
    loop = sentence(rng, 7)
    rows += [" ".join([loop] * 30), " ".join([loop] * 25) + " tail"]
    rows += [rows[3], rows[70], rows[70] + " more", None, ""]
    rng.shuffle(rows)
    return [(3 * i + 1, t) for i, t in enumerate(rows)]


def test_repeated_passages(spark, passage_rows):
    got = {r.doc_id: r for r in substring_dedup.substring_dedup(frame(spark, passage_rows), with_text=True).collect()}
    want = removed_words(dict(passage_rows))
    assert len(got) == len(passage_rows)
    for i, (n, gone, kept) in want.items():
        r = got[i]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (n, gone, hashlib.sha256(kept.encode()).hexdigest())
        assert r.kept_text == kept or (gone == 0 and r.kept_text is None)
    assert sum(w[1] for w in want.values()) > 2000


def test_repeated_passages_awkward(awkward, no_rows):
    rows = substring_dedup.substring_dedup(awkward).collect()
    assert len(rows) == len(awkward_rows())
    gone = {(r.doc_id, r.n_removed) for r in rows}
    assert {(5, 0), (13, 30_000), (8, 0), (9, 120), (10, 120), (None, 0), (1, 0)} <= gone
    assert substring_dedup.substring_dedup(no_rows).count() == 0
