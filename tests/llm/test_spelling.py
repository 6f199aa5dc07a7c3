import random
import zlib

import pytest
from pyspark.sql import functions as F

from ambersift.llm.spelling import letter_signatures, near_words, spelling_variants, word_counts

from .conftest import frame
from .oracle import LOWER

LETTERS = "abcdeéüÿxyz"


def runs_of(text):
    out, run = [], ""
    for c in (text or "").translate(LOWER) + " ":
        if "a" <= c <= "z" or "À" <= c <= "ÿ":
            run += c
        elif run:
            out.append(run)
            run = ""
    return out


def counts(rows):
    out = {}
    for i, t in rows:
        for w in runs_of(t):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % 97 == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            out[w] = out.get(w, 0) + 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    a, b = sorted((a, b), key=len)
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) == len(b)) :] == b[k + 1 :]


def brute(rows):
    n = counts(rows)
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], [ord(c) for c in v]), default=None)
        form[w] = best if best and n[best] >= 2 * n[w] else None
    out = set()
    for w in n:
        end = w
        while form[end]:
            end = form[end]
        out.add((w, form[w], end, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def texts(seed, docs=60, stems=12):
    """Stems and their variants by one or two edits, with falling counts."""
    rng = random.Random(seed)
    known = ["".join(rng.choice(LETTERS) for _ in range(rng.randint(4, 9))) for _ in range(stems)]
    for w in list(known):
        for _ in range(10):
            k, c = rng.randrange(len(w) + 1), rng.choice(LETTERS)
            known.append(rng.choice((w[:k] + c + w[k:], w[:k] + w[k + 1 :], w[:k] + c + w[k + 1 :])))
    rows = []
    for i in range(docs):
        picked = [known[min(int(rng.expovariate(0.04)), len(known) - 1)] for _ in range(80)]
        rows.append((i, rng.choice((" ", "-", "3", "\n")).join(w.title() if rng.random() < 0.1 else w for w in picked)))
    return rows


@pytest.mark.parametrize("limit", [64, 2])
def test_against_brute_force(spark, limit):
    rows = texts(limit) + [(None, "Straße straße STRASSE strasse × a×b÷c")] * 3 + [(5, None), (6, "")]
    got = spelling_variants(frame(spark, rows), limit=limit)
    got = {(r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in got.collect()}
    assert got == brute(rows) and any(r[1] and r[2] != r[1] for r in got)


def test_every_near_pair_shares_a_signature():
    rng = random.Random(1)
    for parts in (3, 5, 7):
        words, other = [], []
        for _ in range(300):
            w = "".join(rng.choice("aab") if rng.random() < 0.5 else rng.choice(LETTERS) for _ in range(rng.randint(1, 30)))
            k, c = rng.randrange(len(w)), rng.choice(LETTERS)
            words.append(w)
            other.append(rng.choice((w[:k] + c + w[k:], w[:k] + w[k + 1 :] or "q", w[:k] + c + w[k + 1 :])))
        a, b = letter_signatures(words, parts), letter_signatures(other, parts)
        assert (a == b).any(axis=1).all()


def test_a_shared_signature_is_split_not_cut(spark):
    """All arrangements of the same letters: every signature is shared by hundreds."""
    rng = random.Random(5)
    words = sorted({"".join(rng.sample("aabbccd", 7)) for _ in range(900)} | {"".join(rng.sample("aabbccdx", 8)) for _ in range(300)})
    table = spark.createDataFrame([(w, 3) for w in words], "word string, n long")
    want = {(a, b) for i, a in enumerate(words) for b in words[i + 1 :] if one_edit(a, b)}
    for limit in (8, 1 << 20):
        assert {tuple(r) for r in near_words(table, limit=limit).collect()} == want
    assert len(want) > 50


def test_awkward_rows(spark, awkward, no_rows):
    got = {(r.word, r.n) for r in word_counts(awkward).collect()}
    from .conftest import awkward_rows

    assert got == set(counts(awkward_rows()).items())
    assert spelling_variants(no_rows).count() == 0
    long = frame(spark, [(k, "y" * 20_000 + " " + "y" * 20_001) for k in range(4)])
    got = spelling_variants(long, noise=0).select(F.length("word"), "n", "n_near", "form")
    assert {tuple(r) for r in got.collect()} == {(20_000, 4, 1, None), (20_001, 4, 1, None)}
