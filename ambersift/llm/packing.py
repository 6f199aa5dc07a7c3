"""Best-fit packing of tokenised documents by a grouping genetic algorithm.

Pieces are dealt by hash to demes of a bounded size. Every deme is evolved on several
islands: an individual is a whole assignment of the deme's pieces to sequences, the
crossover injects whole well-filled sequences of one parent into the other, removes
the sequences that hold duplicates, and puts the displaced pieces back by best fit.
After each epoch an island's best individual migrates to the next island of its deme.
At the end, sequences that are not well filled leave their demes and are evolved once
more in mixed demes, starting from what they were, so the count never rises.

Epochs are Spark jobs over one row per (deme, island); rows are bounded by the deme
size, whatever the input. Seeds come from deme, island and epoch, so a repeated task
repeats its result.

* Null text is empty; an empty document is the end token alone.
* Only documents longer than a sequence are cut; full pieces are sequences of their own.
* Repeated rows are packed once each; null ids are packed like others.
* An empty table gives an empty plan; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import slice_count, written
from .words import Words, absent, row_chunks, table, text_bytes

_LETTER = table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
_PUNCT = table(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")  # no apostrophe: contractions stay whole
MOST_KNOWN = 1_000_000  # words whose ids a task remembers at once


class WordIds:
    """Token ids of whole texts by way of their distinct words.

    For tokenizers that cut at white space, drop it, and cut between an ASCII letter
    and ASCII punctuation other than the apostrophe: there the ids of a text are those
    of its parts. ``separator`` is a special token; it stands between words so that one
    call encodes many.
    """

    def __init__(self, path: str, separator: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        self.separator, self.sep_id = separator, self.tok.token_to_id(separator)
        self._forget()

    def _forget(self) -> None:
        self.known, self.first, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _encode(self, words: list[str]) -> list[np.ndarray]:
        plain = [i for i, w in enumerate(words) if "<|" not in w]
        odd = [i for i, w in enumerate(words) if "<|" in w]
        out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(words)
        groups = [plain[i : i + 512] for i in range(0, len(plain), 512)]
        texts = [self.separator.join(words[i] for i in g) for g in groups]
        for g, enc in zip(groups, self.tok.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(enc.ids, np.uint32)
            cut = np.flatnonzero(ids == self.sep_id)
            for i, a, b in zip(g, [0, *(cut + 1)], [*cut, len(ids)]):
                out[i] = ids[a:b]
        for i in odd:
            out[i] = np.array(self.tok.encode(words[i], add_special_tokens=False).ids, np.uint32)
        return out

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        if len(self.known) + len(hashes) > MOST_KNOWN:
            self._forget()
        ids = self._encode(words)
        count = np.array([len(x) for x in ids], np.int64)
        first = len(self.flat) + np.cumsum(count) - count
        self.flat = np.concatenate([self.flat, *ids])
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known = known[order]
        self.first, self.count = np.concatenate([self.first, first])[order], np.concatenate([self.count, count])[order]

    def ids(self, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the rows' texts, and where each row's ids start, the end included."""
        pair = np.flatnonzero((_LETTER[data[:-1]] & _PUNCT[data[1:]]) | (_PUNCT[data[:-1]] & _LETTER[data[1:]])) + 1
        marks = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
        if len(marks):  # "<|": special tokens are found in the text as it is, so their words stay whole
            whole = Words(data, rows)
            odd = np.searchsorted(whole.start, marks, "right") - 1
            inside = np.searchsorted(whole.start, pair, "right") - 1
            pair = pair[~np.isin(inside, odd)]
        words = Words(data, rows, lower=not len(marks), cut=pair)
        hashes, at, back = np.unique(words.hash, return_index=True, return_inverse=True)
        fresh = np.flatnonzero(absent(hashes, self.known))
        if len(fresh):
            if len(self.known) + len(fresh) > MOST_KNOWN:
                self._forget()
                fresh = np.arange(len(hashes))
            self._learn(hashes[fresh], [words.text(k).decode("utf-8", "replace") for k in at[fresh].tolist()])
        spot = np.searchsorted(self.known, hashes)
        count, first = self.count[spot][back], self.first[spot][back]
        ends = np.cumsum(count)
        total = int(ends[-1]) if len(ends) else 0
        where = np.arange(total) + np.repeat(first - (ends - count), count)
        starts = np.concatenate([[0], ends])
        return self.flat[where], starts[words.at]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def token_pieces(
    docs: DataFrame, tokenizer: str, end_id: int = 0, most: int = 2048, separator: str = "<|startoftext|>",
    with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per piece of at most ``most`` ids; ``ids`` (little-endian, unsigned 32 bits)
    only if asked for. ``tokenizer`` is a path that executors can open."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
         ("ids_crc32", pa.int64()), ("ids", pa.binary())]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordIds(tokenizer, separator)
        for batch in batches:
            data, at = text_bytes(batch.column(1))
            names = batch.column(0).to_pylist()
            cols: list[list] = [[] for _ in schema]
            for a, b in row_chunks(at):
                ids, first = encoder.ids(data[at[a] : at[b]], at[a : b + 1] - at[a])
                ids = ids.astype("<u4")
                for k in range(b - a):
                    own = np.append(ids[first[k] : first[k + 1]], np.uint32(end_id)).astype("<u4")
                    for p, s in enumerate(range(0, len(own), most)):
                        part = own[s : s + most].tobytes()
                        row = (names[a + k], p, s, len(part) // 4, zlib.crc32(part), part if with_ids else None)
                        for c, v in zip(cols, row):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECES)


# One deme: lengths of its pieces; an individual is the sequence number of every piece.


def best_fit(lengths: np.ndarray, order, space: list[tuple[int, int]], bins: np.ndarray, fresh: int, most: int) -> int:
    """Put the pieces of ``order`` into the fullest sequence that takes them; ``space`` is
    sorted (room, number). Returns the next unused number."""
    for i in order:
        need = int(lengths[i])
        k = bisect_left(space, (need, -1))
        if k < len(space):
            room, b = space.pop(k)
        else:
            room, b, fresh = most, fresh, fresh + 1
        bins[i] = b
        if room > need:
            insort(space, (room - need, b))
    return fresh


def fill(lengths: np.ndarray, bins: np.ndarray) -> np.ndarray:
    return np.bincount(bins, weights=lengths).astype(np.int64)


def score(lengths: np.ndarray, bins: np.ndarray, most: int) -> tuple[int, float]:
    """Fewer sequences first, then uneven fills (room gathered in few of them)."""
    f = fill(lengths, bins)
    f = f[f > 0]
    return len(f), -float(np.square(f / most).sum())


def compact(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1].astype(np.int64)


def crossover(lengths: np.ndarray, a: np.ndarray, b: np.ndarray, rng, most: int) -> np.ndarray:
    """Whole well-filled sequences of ``b`` go into ``a``; what they displace is fitted anew."""
    full = fill(lengths, b)
    good = np.argsort(-full, kind="stable")[: max(1, len(full) // 2)]
    taken = np.zeros(len(full), bool)
    taken[good[rng.random(len(good)) < 0.3]] = True
    moved = taken[b]
    if not moved.any():
        return a
    broken = np.zeros(int(a.max()) + 1, bool)
    broken[a[moved]] = True
    # The emptiest sequences of the other parent are broken up too: their pieces get another chance.
    own = fill(lengths, a)
    broken[np.argsort(own, kind="stable")[: max(1, len(own) // 20)]] = True
    loose = np.flatnonzero(broken[a] & ~moved)
    child = a.copy()
    child[moved] = b[moved] + len(own)
    placed = np.ones(len(a), bool)
    placed[loose] = False
    f = np.bincount(child[placed], weights=lengths[placed], minlength=len(own) + len(full)).astype(np.int64)
    live = np.flatnonzero((f > 0) & (f < most))
    space = sorted(zip((most - f[live]).tolist(), live.tolist()))
    best_fit(lengths, loose[np.argsort(-lengths[loose], kind="stable")], space, child, len(f), most)
    return compact(child)


def seedling(lengths: np.ndarray, rng, most: int, noise: float) -> np.ndarray:
    """Best fit by falling length, the lengths blurred by ``noise``."""
    bins = np.zeros(len(lengths), np.int64)
    order = np.argsort(-lengths * (1 + noise * rng.standard_normal(len(lengths))), kind="stable")
    best_fit(lengths, order, [], bins, 0, most)
    return compact(bins)


def evolve(lengths: np.ndarray, start: list[np.ndarray], seed: list[int], most: int, size: int, children: int) -> list[np.ndarray]:
    """The two best individuals after ``children`` crossovers."""
    rng = np.random.default_rng(seed)
    pool = [compact(x) for x in start]
    while len(pool) < size:
        pool.append(seedling(lengths, rng, most, 0.0 if not pool else 0.05))
    ranked = sorted(((score(lengths, x, most), i, x) for i, x in enumerate(pool)), key=lambda r: r[:2])
    least = -(-int(lengths.sum()) // most)
    for k in range(children):
        if ranked[0][0][0] <= least:
            break
        i, j = rng.choice(len(ranked), 2, replace=False)
        child = crossover(lengths, ranked[min(i, j)][2], ranked[max(i, j)][2], rng, most)
        mark = score(lengths, child, most)
        if mark < ranked[-1][0]:
            ranked[-1] = (mark, len(pool) + k, child)
            ranked.sort(key=lambda r: r[:2])
    return [ranked[0][2], ranked[1][2]]


_ISLAND = "deme long, island int, uids array<long>, lengths array<long>, pool array<array<long>>"


def _epoch(rows: DataFrame, epoch: int, most: int, size: int, children: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            pools = []
            for d, i, lengths, pool in zip(pdf["deme"], pdf["island"], pdf["lengths"], pdf["pool"]):
                start = [np.asarray(x, np.int64) for x in pool]
                seed = [int(d), int(i), epoch]
                best = evolve(np.asarray(lengths, np.int64), start, seed, most, size, children)
                pools.append([x.tolist() for x in best])
            yield pdf.assign(pool=pools)

    # Small rows, much work: one task for few islands, not for as many as fit a partition's bytes.
    return rows.repartition(slice_count(rows.sparkSession), "deme", "island").mapInPandas(run, _ISLAND)


def _settle(rows: DataFrame, most: int) -> DataFrame:
    """The best individual of each deme, one row per piece: uid, length, deme, sequence
    number, offset in it, and how full the sequence is."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, uids, lengths, pool in zip(pdf["deme"], pdf["uids"], pdf["lengths"], pdf["pool"]):
                uids, lengths = np.asarray(uids, np.int64), np.asarray(lengths, np.int64)
                bins = min((np.asarray(x, np.int64) for x in pool), key=lambda x: score(lengths, x, most))
                order = np.lexsort((uids, bins))
                run_up = np.cumsum(lengths[order]) - lengths[order]
                first = np.concatenate([[True], np.diff(bins[order]) > 0])
                offset = run_up - np.repeat(run_up[first], np.diff(np.append(np.flatnonzero(first), len(order))))
                yield pd.DataFrame(
                    {"uid": uids[order], "length": lengths[order], "deme": d, "bin": bins[order], "offset": offset,
                     "filled": fill(lengths, bins)[bins[order]]}
                )

    best = rows.groupBy("deme").agg(
        F.first("uids").alias("uids"), F.first("lengths").alias("lengths"), F.flatten(F.collect_list("pool")).alias("pool")
    )
    return best.mapInPandas(run, "uid long, length long, deme long, bin long, offset long, filled long")


def _evolve_demes(demes: DataFrame, islands: int, epochs: int, most: int, size: int, children: int) -> DataFrame:
    """``demes``: deme, uids, lengths, pool. Every epoch is written, so a lost executor
    repeats its islands of one epoch at most."""
    rows = demes.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1))))
    rows = rows.select("deme", "island", "uids", "lengths", "pool")
    for epoch in range(epochs):
        rows = written(_epoch(rows, epoch, most, size, children))
        if epoch + 1 < epochs:
            guest = rows.select("deme", ((F.col("island") + 1) % islands).alias("island"), F.slice("pool", 1, 1).alias("guest"))
            rows = rows.join(guest, ["deme", "island"]).withColumn("pool", F.concat("pool", "guest")).drop("guest")
    return _settle(rows, most)


def pack(
    pieces: DataFrame, most: int = 2048, deme_size: int = 2048, islands: int = 2, epochs: int = 2,
    size: int = 5, children: int = 12, loose_below: float = 0.99,
) -> DataFrame:
    """``pieces`` (``uid``, unique, and ``length``) with ``sequence_id`` and ``offset``."""
    whole = pieces.filter(F.col("length") >= most).select(
        "uid", F.bitwise_not("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset")
    )
    rest = pieces.filter(F.col("length") < most).select("uid", "length")

    def demes_of(rows, key, n, pool):
        got = rows.withColumn("deme", F.pmod(F.xxhash64(*key, F.lit(n)), F.lit(n)).cast("long"))
        got = got.groupBy("deme").agg(F.sort_array(F.collect_list(F.struct("uid", "length", *pool))).alias("of"))
        return got.select("deme", F.col("of.uid").alias("uids"), F.col("of.length").alias("lengths"), "of")

    n = max(1, -(-rest.count() // deme_size))
    none = F.array().cast("array<array<long>>").alias("pool")
    first = demes_of(rest, ["uid"], n, []).select("deme", "uids", "lengths", none)
    first = written(_evolve_demes(first, islands, epochs, most, size, children))
    done = first
    if n > 1:
        loose = first.filter(F.col("filled") < int(loose_below * most)).withColumn("was", F.shiftleft("deme", 24) + F.col("bin"))
        settled = first.filter(F.col("filled") >= int(loose_below * most))
        # Whole sequences move together, so the old assignment is an individual of the new deme.
        m = max(1, -(-loose.count() // deme_size))
        mixed = demes_of(loose, ["was"], m, ["was"])
        place = F.transform("of", lambda x: F.array_position(F.array_distinct(F.col("of.was")), x["was"]) - 1)
        mixed = mixed.select("deme", "uids", "lengths", F.array(place.cast("array<long>")).alias("pool"))
        again = _evolve_demes(mixed, islands, 1, most, size, 3 * children).withColumn("deme", F.col("deme") + n)
        done = settled.select("uid", "deme", "bin", "offset").unionByName(again.select("uid", "deme", "bin", "offset"))
    done = done.select("uid", (F.shiftleft("deme", 24) + F.col("bin")).alias("sequence_id"), "offset")
    return done.unionByName(whole)


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, most: int = 2048, **how) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = token_pieces(docs, tokenizer, end_id, most).drop("ids")
    pieces = written(pieces.withColumn("uid", F.monotonically_increasing_id()))
    return pieces.join(pack(pieces, most, **how), "uid").drop("uid")
