import collections
import hashlib

import numpy as np
import pytest

from ambersift.llm import alignment
from ambersift.llm.alignment import Tokenizers, align, blocks, common_ends, gallop, pair_counts, pairs_by_id
from ambersift.llm.tables import tokenizer

from .conftest import awkward_rows, frame

ODD = [
    "", "a ▁ b", " lead", "  two  Spaces x", "tab\tx  \n y <s> </s><|endoftext|> <0x0A> z", "é  a  b", "\x00 zero \x00",
    "😀 🎉 " * 60, "x" * 15_000, "漢字 かな a 한국어 b", "don't 'S it's  I'll", "　 wide A \x85 B\x1c C", "ÁÁ aÁ b▁ c",
    "a\nb\n\nc \n d\r\ne 12 34.5 -- x", "\n", " ", "\nx", "x ", "x\n", "trailing \n ",
]


@pytest.fixture(scope="module")
def paths():
    return tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model")


def brute(tok, texts):
    """Whole texts, token by token."""
    out, held, all_links = [], collections.Counter(), []
    for t in texts:
        s = " " + t if t else ""
        a = tok.a.encode(s, add_special_tokens=False).ids if t else []
        b = tok.b.encode(t) if t else []
        if any(b"".join(of[k] for k in ids) != s.encode() for of, ids in ((tok.bytes_a, a), (tok.bytes_b, b))):
            a, b = [], []
        ends_a = np.cumsum([len(tok.bytes_a[k]) for k in a]).tolist()
        ends_b = np.cumsum([len(tok.bytes_b[k]) for k in b]).tolist()
        groups, i, j = [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            x, y = ends_a.index(end, i) + 1, ends_b.index(end, j) + 1
            groups.append((a[i:x], b[j:y]))
            i, j = x, y
        links = [(p, q) for g, h in groups for p in g for q in h]
        held.update(set(links))
        all_links.append(links)
        digest = ";".join(",".join(map(str, g)) + "|" + ",".join(map(str, h)) for g, h in groups)
        out.append((len(a), len(b), len(groups), len(links), hashlib.sha256(digest.encode()).hexdigest() if a else ""))
    most = collections.Counter()
    for (a, _), n in held.items():
        most[a] = max(most[a], n)
    rows = [
        (*o[:4], sum(held[p] == most[p[0]] for p in links), sum(held[p] for p in links), o[4])
        for o, links in zip(out, all_links)
    ]
    return rows, held, most


def test_gallop():
    rng = np.random.default_rng(2)
    for _ in range(300):
        a = np.unique(rng.integers(0, rng.integers(5, 3000), rng.integers(0, 500)))
        b = np.unique(rng.integers(0, rng.integers(5, 5000), rng.integers(0, 2000)))
        assert (gallop(a, b) == np.searchsorted(b, a)).all()
        x, y = common_ends(a, b)
        assert (a[x] == np.intersect1d(a, b)).all() and (b[y] == a[x]).all()


def test_against_brute_force(spark, paths, monkeypatch):
    monkeypatch.setattr(alignment, "BLOCK", 1 << 16)
    texts = [t for _, t in awkward_rows() if t is None or len(t) < 20_000] + ODD
    docs = frame(spark, list(enumerate(texts))).repartition(3)
    got = {r[0]: tuple(r)[1:] for r in align(docs, *paths).collect()}
    want, held, most = brute(Tokenizers(*paths), texts)
    assert got == dict(enumerate(want))
    counts = {(r.a, r.b): (r.n, r.best) for r in pairs_by_id(pair_counts(blocks(docs, *paths))).collect()}
    assert counts == {p: (n, n == most[p[0]]) for p, n in held.items()}


def test_units_without_cuts(paths):
    """A vocabulary that allows no cut gives the same rows, each text as one unit."""
    import pyarrow as pa

    texts = [t for t in ODD if t] + [t for _, t in awkward_rows() if t and len(t) < 5000]
    tok = Tokenizers(*paths)
    one = alignment.read_block(pa.array(range(len(texts))), pa.array(texts), tok)
    tok.cuts, tok.ascii = False, None
    two = alignment.read_block(pa.array(range(len(texts))), pa.array(texts), tok)
    assert all(np.array_equal(one[k], two[k]) for k in one)


def test_awkward_rows(spark, awkward, no_rows, paths):
    got = align(awkward, *paths).collect()
    assert len(got) == awkward.count()
    for r in got:
        if r.doc_id in (1, 2):
            assert tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "")
        if r.doc_id == 4:
            assert r.n_a > 0 and r.groups_sha256
    assert align(no_rows, *paths).count() == 0


def test_block_is_worked_on_in_slices(paths, monkeypatch):
    """Tokens of a whole block never stand there at once, and slices give the same row."""
    import pyarrow as pa

    texts = [None, *ODD, *[t for _, t in awkward_rows() if t and len(t) < 5000], ""]
    texts += [" ".join(f"word{i * k % 997} é{k}" for i in range(200)) for k in range(40)]
    tok, most = Tokenizers(*paths), []
    monkeypatch.setattr(alignment, "SLICE", 1 << 30, raising=False)
    whole = alignment.read_block(pa.array(range(len(texts))), pa.array(texts), tok)
    encode = tok.encode
    monkeypatch.setattr(alignment, "SLICE", 1 << 14, raising=False)
    monkeypatch.setattr(tok, "encode", lambda units: most.append(sum(len(u.encode()) for u in units)) or encode(units))
    row = alignment.read_block(pa.array(range(len(texts))), pa.array(texts), tok)
    assert all(np.array_equal(row[k], whole[k]) for k in whole)
    assert len(most) > 1 and max(most) <= 1 << 14


def test_long_lists_of_a_block_are_pressed(spark, paths):
    docs = frame(spark, [(k, " ".join(f"word{i * (k + 1) % 97} and more" for i in range(200))) for k in range(20)])
    row = blocks(docs.coalesce(1), *paths).first()
    assert isinstance(row.held, bytes | bytearray) and len(row.held) + len(row.times) < 4 * row.held_at[-1]
    for n in (0, 1, 9):
        values = np.arange(n) * 7 - 3
        pressed = alignment.pa.scalar(alignment._pressed(values), alignment.pa.binary())
        assert alignment._unpressed(pressed, n).tolist() == values.tolist()
