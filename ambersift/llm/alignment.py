"""Alignment of two tokenizers: groups of tokens over the same bytes, and corpus counts.

A byte-level tokenizer (A) and a sentence-piece tokenizer (B) encode the same text. Byte
offsets at which tokens of both end cut a text into groups; they are the intersection of
two sorted lists of ends. The shorter list drives: each of its ends is looked for in the
longer one by an exponential search that starts where an earlier end was found, then a
binary one. The ranks at which common ends stand in both lists slice the groups: rank
differences give each group's range of A and of B tokens. All pairs of a group are links.

A text is read in units: it is cut before a blank that stands alone between visible
characters and before a line end that follows one, where neither tokenizer can have a token
across (that no piece of B holds such a place is checked; else a whole text is one unit). Different units of a block of texts are
encoded once, a slice of them at a time, and the pairs of its texts are gathered slice by
slice: lists of tokens and links never stand there for a whole block. A block's units, links and pairs of ids are one row of a table; pair counts
go from blocks to Spark, which adds them up, and come back only for the pairs of a block.

* Null and empty texts, and texts whose tokens do not spell them, have no tokens: zeros
  and an empty digest. Rows that repeat an id or a text are documents of their own.
* A very long text is a block of its own, as is its list of pairs; long units are encoded
  whole.
* Ties: every link whose count is its A id's highest counts as best.
* An empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import ctypes
import gc
import hashlib
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .tables import join_counted
from .words import row_chunks, table, text_bytes

BLOCK = 1 << 23  # bytes of text of a block
SLICE = 1 << 18  # bytes of units, or of texts, that are worked on at once
STRIDE = 64
#: How a byte-level vocabulary of this kind cuts a text before merging (fixed).
WORD = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLANK = "▁"
_SPACE, _LINE = 0x20, 0x0A
#: Bytes that a visible character starts with: ASCII ones, U+00C0 to U+07FF (no blanks there).
_VISIBLE = table(bytes([*range(0x21, 0x7F), *range(0xC3, 0xE0)]))
_ASCII = table(bytes(range(0x21, 0x7F)))
_PAIR = 1 << 31


def gallop(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Where each value of ``short`` stands in ``long`` or would be put; both rise.

    Every ``STRIDE``-th value is looked up first (by the same search); the values that
    follow it start from there, all side by side: steps of 1, 2, 4, ... until a value is
    not smaller, then halving within the last step."""
    if len(short) <= STRIDE:
        low = np.zeros(len(short), np.int64)
    else:
        low = np.repeat(gallop(short[::STRIDE], long), STRIDE)[: len(short)]
    high, step = low.copy(), 1
    open_ = np.flatnonzero(np.r_[long, np.iinfo(np.int64).max][low] < short)
    while len(open_):
        low[open_] = high[open_] + 1
        high[open_] = np.minimum(low[open_] + step, len(long))
        step *= 2
        inside = open_[high[open_] < len(long)]
        open_ = inside[long[high[inside]] < short[inside]]
    while True:
        open_ = np.flatnonzero(low < high)
        if not len(open_):
            return low
        middle = (low[open_] + high[open_]) // 2
        less = long[middle] < short[open_]
        low[open_[less]] = middle[less] + 1
        high[open_[~less]] = middle[~less]


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks in ``a`` and in ``b`` of the values that both rising lists hold."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    at = gallop(short, long)
    hit = np.flatnonzero(np.r_[long, -1][at] == short)
    return (hit, at[hit]) if short is a else (at[hit], hit)


class Tokenizers:
    """Both tokenizers and the bytes of their tokens, opened once per task."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task per core already
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        code = byte_alphabet()
        ids = self.a.get_vocab()
        self.bytes_a = [b""] * (max(ids.values()) + 1)
        for token, k in ids.items():
            self.bytes_a[k] = bytes(code[c] for c in token) if all(c in code for c in token) else token.encode()
        self.ascii = self._ascii_encoder(path_a, ids)
        pieces = [self.b.id_to_piece(k) for k in range(self.b.get_piece_size())]
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(k) else p.replace(BLANK, " ").encode() for k, p in enumerate(pieces)
        ]
        self.size_a, self.size_b = (np.array([len(t) for t in s], np.int64) for s in (self.bytes_a, self.bytes_b))
        #: Whether a blank after another character always begins a token of B, and a line end is one.
        self.cuts = not any(BLANK in p.lstrip(BLANK) or "\n" in p for p in pieces)
        # A token's id in a digest, followed by ",", or by "|" or ";" if it ends a group's side.
        n = len(self.bytes_a)
        self.marks = [f"{k}{e}" for e in ",|" for k in range(n)] + [f"{k}{e}" for e in ",;" for k in range(len(pieces))]

    def _ascii_encoder(self, path: str, ids: dict[str, int]):
        """The same encoding by rank, which is faster for short texts, if A is a byte-level BPE
        whose ids rise in the order of its merges; else None. It is used for ASCII units, in
        which character classes cannot differ between the two libraries."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"].get("merges", ())]
        split = spec.get("pre_tokenizer") or {}
        made = [ids.get(a + b, -1) for a, b in merges]
        plain = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space")
        if not plain or spec.get("normalizer") or not made or sorted(set(made)) != made or made[0] < 0:
            return None
        import tiktoken

        ranks = {self.bytes_a[k]: k for k in [*made, *(ids[c] for c in byte_alphabet())]}
        return tiktoken.Encoding("ascii", pat_str=WORD, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of A and B of units: each begins with a blank, which B adds itself, or with a
        line end, in front of which B's blank is a token of its own and is dropped."""
        other = [t for t in texts if not (self.ascii and t.isascii())]
        slow = iter(self.a.encode_batch(other, add_special_tokens=False))
        a = [self.ascii(t) if self.ascii and t.isascii() else next(slow).ids for t in texts]
        b = self.b.encode([t.removeprefix(" ") for t in texts], num_threads=1)
        return a, [x if t.startswith(" ") else x[1:] for x, t in zip(b, texts)]


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if it can
    be seen, else the next free one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in seen}
    return out | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in seen)}


def _flat(lists: list) -> tuple[np.ndarray, np.ndarray]:
    """All values of the lists, and where each list starts (the end included)."""
    at = np.zeros(len(lists) + 1, np.int64)
    np.cumsum([len(x) for x in lists], out=at[1:])
    return np.fromiter((v for x in lists for v in x), np.int64, int(at[-1])), at


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... of ``size[0]`` values, then those of the next."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


class _Slice:
    """Tokens, groups and links of some units."""

    def __init__(self, units: list[str], tok: Tokenizers):
        lists_a, lists_b = tok.encode(units)
        want = [u.encode() for u in units]
        self.good = np.array([
            b"".join([tok.bytes_a[k] for k in x]) == w and b"".join([tok.bytes_b[k] for k in y]) == w
            for x, y, w in zip(lists_a, lists_b, want)
        ], bool)
        # A unit that its tokens do not spell makes its texts empty; its own tokens are not needed.
        lists_a = [x if g else [] for x, g in zip(lists_a, self.good)]
        lists_b = [x if g else [] for x, g in zip(lists_b, self.good)]
        a, at_a = _flat(lists_a)
        b, at_b = _flat(lists_b)
        self.n_a, self.n_b = np.diff(at_a), np.diff(at_b)
        rank_a, rank_b = common_ends(np.cumsum(tok.size_a[a]), np.cumsum(tok.size_b[b]))
        # Group g holds the tokens after common end g - 1, up to common end g.
        start_a, start_b = np.r_[0, rank_a[:-1] + 1][: len(rank_a)], np.r_[0, rank_b[:-1] + 1][: len(rank_b)]
        size_a, size_b = rank_a + 1 - start_a, rank_b + 1 - start_b
        group_at = np.searchsorted(rank_a, at_a)  # every unit ends at a common end
        self.n_groups = np.diff(group_at)
        links = np.r_[0, np.cumsum(size_a * size_b)]
        self.n_links = np.diff(links[group_at])
        self.digests = self._digests(a, b, rank_a, rank_b, size_a, size_b, at_a + at_b, tok)
        self._pairs(a, b, size_a, start_b, size_b, group_at)

    def _digests(self, a, b, rank_a, rank_b, size_a, size_b, ends, tok) -> list[str]:
        n, m = len(tok.bytes_a), len(tok.bytes_b)
        marks = np.empty(len(a) + len(b), np.int64)
        group_a, group_b = np.repeat(np.arange(len(size_a)), size_a), np.repeat(np.arange(len(size_b)), size_b)
        before_b, upto_a = np.cumsum(size_b) - size_b, np.cumsum(size_a)
        last_a, last_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
        last_a[rank_a], last_b[rank_b] = True, True
        marks[np.arange(len(a)) + before_b[group_a]] = a + n * last_a
        marks[np.arange(len(b)) + upto_a[group_b]] = 2 * n + b + m * last_b
        out = [tok.marks[k] for k in marks.tolist()]
        ends = ends.tolist()
        return ["".join(out[s:e]) for s, e in zip(ends, ends[1:])]

    def _pairs(self, a, b, size_a, start_b, size_b, group_at) -> None:
        """Different pairs of ids: ``pairs``; ``pair``, ``times`` of each unit, which has ``n_pairs``."""
        unit = np.repeat(np.arange(len(group_at) - 1), np.diff(group_at))
        # Every A token of a group meets all B tokens of it.
        group = np.repeat(np.arange(len(size_a)), size_a)
        right = _runs(start_b[group], size_b[group])
        codes = np.repeat(a, size_b[group]) * _PAIR + b[right]
        self.pairs, code = np.unique(codes, return_inverse=True)
        key = np.repeat(unit[group], size_b[group]) * max(len(self.pairs), 1) + code
        key, times = np.unique(key, return_counts=True)
        owner, pair = np.divmod(key, max(len(self.pairs), 1))
        self.pair, self.times = pair.astype(np.int32), times.astype(np.int32)
        self.n_pairs = np.bincount(owner, minlength=len(group_at) - 1)


class Units:
    """Tokens, groups and links of different units of text, made slice by slice."""

    def __init__(self, units: pa.Array, tok: Tokenizers):
        sizes = np.array(pc.binary_length(units), np.int64)
        parts = [_Slice(units.slice(s, e - s).to_pylist(), tok) for s, e in row_chunks(np.r_[0, np.cumsum(sizes)], SLICE)]

        def whole(name: str, kind: type) -> np.ndarray:
            return np.concatenate([np.zeros(0, kind), *[getattr(p, name) for p in parts]])

        self.good = whole("good", bool)
        self.n_a, self.n_b, self.n_groups, self.n_links = (whole(n, np.int64) for n in ("n_a", "n_b", "n_groups", "n_links"))
        self.digests = [d for p in parts for d in p.digests]
        self.pairs = np.unique(whole("pairs", np.int64))
        for p in parts:
            p.pair = np.searchsorted(self.pairs, p.pairs).astype(np.int32)[p.pair]
        self.pair, self.times = whole("pair", np.int32), whole("times", np.int32)
        self.pair_at = np.r_[0, np.cumsum(whole("n_pairs", np.int64))]


def unit_starts(data: np.ndarray, starts: np.ndarray, cuts: bool) -> np.ndarray:
    """Where units begin in texts that each start with a blank at ``starts``."""
    if not cuts or len(data) < 3:
        return starts
    cut = np.zeros(len(data), bool)
    # Not after a blank, nor after the mark by which B writes one (it ends with byte 0x81).
    cut[1:-1] = (data[1:-1] == _SPACE) & _VISIBLE[data[2:]] & (data[:-2] != _SPACE) & (data[:-2] != 0x81)
    cut[1:] |= (data[1:] == _LINE) & _ASCII[data[:-1]]
    cut[starts] = True
    return np.flatnonzero(cut)


BLOCK_FIELDS = (
    "part long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, "
    "digest array<string>, held binary, held_at array<long>, times binary, pairs array<long>, docs array<int>"
)


def read_block(ids: pa.Array, texts: pa.Array, tok: Tokenizers) -> dict:
    """One row of ``blocks``, before ``_pressed``: digests of the texts, the pairs they hold (``held`` from
    ``held_at``, ``times``), the block's different pairs and in how many texts each is."""
    rows = len(texts)
    here = np.array(pc.greater(pc.fill_null(pc.binary_length(texts), 0), 0))
    kept = texts.filter(pa.array(here)).cast(pa.large_string())
    kept = pc.binary_join_element_wise(pa.scalar("", pa.large_string()), kept, pa.scalar(" ", pa.large_string()))
    data, at = text_bytes(kept)
    starts = unit_starts(data, at[:-1], tok.cuts)
    offsets = np.r_[starts, len(data)].astype(np.int64)
    units = pa.Array.from_buffers(
        pa.large_string(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data)]
    ).dictionary_encode()
    of = units.indices.to_numpy(zero_copy_only=False)
    known = Units(units.dictionary, tok)
    first = np.searchsorted(starts, at)  # units of each text
    bad = np.zeros(len(kept), bool)
    bad[np.searchsorted(first, np.flatnonzero(~known.good[of]), "right") - 1] = True

    def total(values: np.ndarray) -> list[int]:
        out = np.zeros(rows, np.int64)
        sums = np.r_[0, np.cumsum(values[of])]
        out[here] = np.where(bad, 0, sums[first[1:]] - sums[first[:-1]])
        return out.tolist()

    digest = [""] * rows
    for k, row in enumerate(np.flatnonzero(here).tolist()):
        if not bad[k]:
            text = "".join([known.digests[u] for u in of[first[k] : first[k + 1]].tolist()])
            digest[row] = hashlib.sha256(text[:-1].encode()).hexdigest()
    n_held = np.zeros(len(kept), np.int64)
    held, times = [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for s, e in row_chunks(at, SLICE):
        n_held[s:e], *new = _held(known, of[first[s] : first[e]], first[s : e + 1] - first[s], bad[s:e])
        held.append(new[0])
        times.append(new[1])
    held, times = np.concatenate(held), np.concatenate(times)
    held_at = np.zeros(rows + 1, np.int64)
    held_at[1:][here] = n_held
    np.cumsum(held_at, out=held_at)
    return {
        "doc_id": ids.to_pylist(), "n_a": total(known.n_a), "n_b": total(known.n_b), "n_groups": total(known.n_groups),
        "n_links": total(known.n_links), "digest": digest, "held": held, "held_at": held_at, "times": times,
        "pairs": known.pairs, "docs": np.bincount(held, minlength=len(known.pairs)),
    }


def _held(known: Units, of: np.ndarray, first: np.ndarray, bad: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of texts with the units ``of`` from ``first``: those of a text's different units,
    as often as the units occur. How many each text has, the pairs, and their numbers."""
    text = np.repeat(np.arange(len(bad)), np.diff(first))
    seen, often = np.unique((text * len(known.good) + of)[~bad[text]], return_counts=True)
    text_of, unit_of = np.divmod(seen, max(len(known.good), 1))
    size = np.diff(known.pair_at)[unit_of]
    spot = _runs(known.pair_at[unit_of], size)
    n = max(len(known.pairs), 1)
    key = np.repeat(text_of, size) * n + known.pair[spot]
    key, inverse = np.unique(key, return_inverse=True)
    times = np.bincount(inverse, known.times[spot] * np.repeat(often, size), len(key)).astype(np.int64)
    owner, held = np.divmod(key, n)
    return np.bincount(owner, minlength=len(bad)), held.astype(np.int32), times


_TYPES = [
    pa.int64(), *[pa.list_(pa.int64())] * 5, pa.list_(pa.string()), pa.binary(), pa.list_(pa.int64()),
    pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()),
]
_NAMES = [f.split()[0] for f in BLOCK_FIELDS.split(", ")]


def _pressed(values: np.ndarray) -> bytes:
    """A long list of a block, which Spark moves as a few bytes a value less than as an array."""
    return pa.compress(np.ascontiguousarray(values, np.int32), codec="zstd", asbytes=True)


def _unpressed(data: pa.Scalar, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data.as_buffer(), 4 * n, codec="zstd"), np.int32)


def _let_go() -> None:
    """Give free memory back; an idle worker would keep it while later stages fill the heap."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def blocks(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The texts as rows of up to ``BLOCK`` bytes, tokenized, aligned and counted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = Tokenizers(path_a, path_b)
        part = TaskContext.get().partitionId() << 32
        for batch in batches:
            sizes = np.array(pc.fill_null(pc.binary_length(batch["text"]), 0), np.int64)
            for s, e in row_chunks(np.r_[0, np.cumsum(sizes)], BLOCK):
                row = read_block(batch["id"].slice(s, e - s), batch["text"].slice(s, e - s), tok) | {"part": part}
                row |= {"held": _pressed(np.diff(row["held"], prepend=0)), "times": _pressed(row["times"])}
                part += 1
                _let_go()
                yield pa.RecordBatch.from_arrays([pa.array([row[n]], t) for n, t in zip(_NAMES, _TYPES)], _NAMES)
        batch = row = tok = None
        _let_go()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, BLOCK_FIELDS)


DOC_FIELDS = (
    "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
)


def _finish(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    """Documents of one block, with the corpus counts of its pairs."""
    block = {n: left[n][0].values for n in _NAMES[1:] if n not in ("held", "times")}
    size = len(block["pairs"])
    count, best = np.zeros(size, np.int64), np.zeros(size, bool)
    spot = right["spot"].to_numpy()
    count[spot], best[spot] = right["n"].to_numpy(), right["best"].to_numpy()
    at = block["held_at"].to_numpy()
    held = np.cumsum(_unpressed(left["held"][0], at[-1]), dtype=np.int64)
    times = _unpressed(left["times"][0], at[-1]).astype(np.int64)

    def total(values: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(values)]
        return sums[at[1:]] - sums[at[:-1]]

    columns = [block[n] for n in ("doc_id", "n_a", "n_b", "n_groups", "n_links")]
    columns += [pa.array(total(times * best[held])), pa.array(total(times * count[held])), block["digest"]]
    return pa.table(dict(zip([f.split()[0] for f in DOC_FIELDS.split(", ")], columns)))


def id_a(pair: Column) -> Column:
    return F.shiftright(pair, 31)


def pair_counts(table: DataFrame) -> DataFrame:
    """(pair, n, blocks, best): in how many texts and blocks each pair of ids is linked, and
    whether no pair of the same A id is linked in more texts."""
    rows = table.select(F.explode(F.arrays_zip("pairs", "docs")).alias("p")).select("p.pairs", "p.docs")
    counts = written(rows.groupBy(F.col("pairs").alias("pair")).agg(F.sum("docs").alias("n"), F.count(F.lit(1)).alias("blocks")))
    most = counts.groupBy(id_a(F.col("pair")).alias("a")).agg(F.max("n").alias("most"))
    out = counts.join(most, id_a(F.col("pair")) == F.col("a"))
    return out.select("pair", "n", "blocks", (F.col("n") == F.col("most")).alias("best"))


def pairs_by_id(counts: DataFrame) -> DataFrame:
    """``pair_counts`` with the ids apart: a, b, n (texts), best."""
    b = F.col("pair").bitwiseAND(F.lit(_PAIR - 1)).cast("int").alias("b")
    return counts.select(id_a(F.col("pair")).cast("int").alias("a"), b, "n", "best")


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: ``doc_id``, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best``,
    ``count_sum``, ``groups_sha256``."""
    table = written(blocks(docs, path_a, path_b, id_col, text_col))
    counts = written(pair_counts(table))
    asked = table.select(F.col("part").alias("block"), F.posexplode("pairs").alias("spot", "pair"))
    values = join_counted(asked, counts, "pair", "blocks").select("block", "spot", "n", "best")
    return table.groupBy("part").cogroup(values.groupBy("block")).applyInArrow(_finish, DOC_FIELDS)
