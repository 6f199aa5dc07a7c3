"""An interpolated trigram model, kept as an Elias-Fano trie and queried in place.

Counts come from Spark. The trie is cut into shards by hash, so a frequent word's
successors lie in many of them. A shard is a file of 64-bit arrays in the shared folder,
which tasks map and search without reading it: sorted word hashes (level 1), and below
every word its sorted successors (level 2), and below every pair its sorted successors
(level 3). Levels are monotone sequences: pointers say where the children of an entry
start, and a child is found by successor search among them. Discounted probabilities
and back-off weights are 16-bit codes on a logarithmic grid.

    p(w)       = (c(w) + 0.5) / (N + 0.5 (V + 1))
    p(w | v)   = d(vw) + b(v) p(w),      d = (c(vw) - D) / c(v) for kept pairs
    p(w | uv)  = d(uvw) + b(uv) p(w | v)

``b`` is the mass that the kept successors leave, so each distribution sums to one (up to
the grid's 0.03 %). N-grams that occur once are not kept (``least`` = 2, as usual for
large models); their mass is part of ``b``. An n-gram that occurs twice is made of parts
that do, so only such candidates are counted, which loses nothing.

* Tokens: A-Z in lower case, runs of other than blank, tab and line ends, then one end
  token per text. Null, empty and blank texts are the end token alone.
* Words are told apart by 64-bit hashes; there may be fewer than 2**32 different ones.
* Rows in the held-out fold, by id, are never learnt from; rows without an id are.
* Repeated rows count as often as they occur. Without training rows N = V = 0 and all
  words are unknown. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir, written
from .elias_fano import EliasFano
from .words import absent, words_of

END = 0xE4D0E4D0E4D0E4D1  # the end token's hash
GRID = 16 / 65535  # codes: minus log10, from 0 to 16
SHARD_ENTRIES = 1 << 19
MERGED_ROWS = 1_000_000  # n-grams a task adds up before it hands them on
_SHIFT = np.uint64(32)


def encode(p: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-np.log10(np.maximum(p, 1e-16)) / GRID), 0, 65535).astype(np.uint16)


_DECODED = 10.0 ** (-GRID * np.arange(1 << 16))


def decode(code: np.ndarray) -> np.ndarray:
    return _DECODED[code]


def held_out(id_col: Column, folds: int = 5, fold: int = 1) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds == fold, F.lit(False))


# Files of named arrays: a directory of (name, dtype, length), then the arrays at multiples of 8 bytes.


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def save(path: str, arrays: dict[str, np.ndarray]) -> None:
    """Write under another name first, so that a repeated task never shows half a file."""
    parts, head, at = [], [], 0
    for name, a in arrays.items():
        data = np.ascontiguousarray(a).tobytes()
        parts.append(data + bytes(-len(data) % 8))
        head.append(f"{name} {a.dtype.str} {len(a)} {at}")
        at += len(parts[-1])
    lines = "\n".join(head).encode()
    lines += b"\n" * (-(len(lines) + 8) % 8)
    fs, target = _open(path)
    fs.create_dir(target.rpartition("/")[0], recursive=True)
    made = f"{target}.{uuid.uuid4().hex}"
    with fs.open_output_stream(made) as out:
        out.write(len(lines).to_bytes(8, "little") + lines + b"".join(parts))
    fs.move(made, target)


def load(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file: mapped if the folder is a mounted one, else read."""
    fs, target = _open(path)
    data = pa.memory_map(target).read_buffer() if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(target).read_buffer()
    size = int.from_bytes(data[:8], "little")
    out = {}
    for line in bytes(data[8 : 8 + size]).decode().split("\n"):
        if line:
            name, kind, n, at = line.split(" ")
            out[name] = np.frombuffer(data, np.dtype(kind), int(n), 8 + size + int(at))
    return out


def sequence(arrays: dict[str, np.ndarray], name: str) -> EliasFano:
    return EliasFano(*(arrays[f"{name}.{part}"] for part in ("meta", "low", "high", "zeros")))


def named(name: str, ef: EliasFano) -> dict[str, np.ndarray]:
    return {f"{name}.{part}": a for part, a in zip(("meta", "low", "high", "zeros"), ef.arrays())}


@dataclass
class Vocabulary:
    """Level 1: shard by the top bits of a word's hash; an id is the shard's base plus the
    place in it, so ids follow the hashes."""

    folder: str
    bits: int
    base: np.ndarray  # first id of each shard, the end included
    total: int  # N
    open_: dict = field(default_factory=dict)

    @property
    def size(self) -> int:
        return int(self.base[-1])

    def shard(self, s: int) -> dict:
        if s not in self.open_:
            arrays = load(f"{self.folder}/words-{s}")
            self.open_[s] = (sequence(arrays, "hash"), arrays["count"], arrays.get("backoff"))
        return self.open_[s]

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted word hashes, -1 for unknown ones."""
        out = np.full(len(hashes), -1)
        rest = 64 - self.bits
        cut = np.searchsorted(hashes, np.arange(1, 1 << self.bits, dtype=np.uint64) << np.uint64(rest))
        for s, (a, b) in enumerate(zip([0, *cut], [*cut, len(hashes)])):
            if a < b and self.base[s] < self.base[s + 1]:
                key = hashes[a:b] & np.uint64((1 << rest) - 1) if rest < 64 else hashes[a:b]
                at = self.shard(s)[0].find(key)
                out[a:b] = np.where(at < 0, -1, at + self.base[s])
        return out

    def _of(self, ids: np.ndarray, part: int) -> np.ndarray:
        out = np.zeros(len(ids), np.int64)
        shard = np.searchsorted(self.base, ids, "right") - 1
        for s in np.unique(shard):
            mine = shard == s
            values = self.shard(int(s))[part]
            out[mine] = 0 if values is None else values[ids[mine] - self.base[s]]
        return out

    def counts(self, ids: np.ndarray) -> np.ndarray:
        return self._of(ids, 1)

    def backoff(self, ids: np.ndarray) -> np.ndarray:
        return decode(self._of(ids, 2))

    def base_p(self, counts: np.ndarray) -> np.ndarray:
        """p(w) by count, 0 for unknown words."""
        return (counts + 0.5) / (self.total + 0.5 * (self.size + 1))


def _by_shard(home: np.ndarray, shards: int) -> Iterator[tuple[int, np.ndarray]]:
    """(shard, places in ``home``, ascending) of the shards that occur."""
    order = np.argsort(home.astype(np.uint16) if shards < 1 << 16 else home, kind="stable")
    cut = np.cumsum(np.bincount(home, minlength=shards))
    for s in np.flatnonzero(np.diff(cut, prepend=0)):
        yield int(s), order[cut[s - 1] if s else 0 : cut[s]]


@dataclass
class Pairs:
    """Levels 2 and 3: the shard is the pair (context id, word id), as one number, modulo
    the number of shards, so the successors of a frequent word lie in all of them."""

    folder: str
    shards: int
    words: int  # V
    open_: dict = field(default_factory=dict)

    def shard(self, s: int) -> dict:
        if s not in self.open_:
            try:
                arrays = load(f"{self.folder}/pairs-{s}")
            except FileNotFoundError:  # no pair has this home
                arrays = {}
            seqs = {n: sequence(arrays, n) for n in ("context", "first", "word", "children", "third") if f"{n}.meta" in arrays}
            self.open_[s] = (seqs, arrays)
        return self.open_[s]

    def find(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Shard of each of the sorted pairs and its place on level 2 there, -1 if it is not kept."""
        home, out = np.mod(pair.view(np.int64), self.shards), np.full(len(pair), -1)
        for s, mine in _by_shard(home, self.shards):
            seqs, _ = self.shard(s)
            if not seqs:
                continue
            # Each context once: its place on the top level, and by the pointers the range of
            # its successors, in which the word is searched.
            above = pair[mine] >> _SHIFT
            new = np.flatnonzero(np.concatenate([[True], above[1:] != above[:-1]]))
            context = seqs["context"].find(above[new])
            known = context >= 0
            first, end = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
            low, high = seqs["first"].span(context[known])
            first[known], end[known] = low, high
            which = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(mine))))
            some = known[which]
            mine, which = mine[some], which[some]
            key = context[which].astype(np.uint64) * np.uint64(self.words) + (pair[mine] & np.uint64(0xFFFFFFFF))
            out[mine] = seqs["word"].find(key, first[which], end[which])
        return home, out

    def values(self, home: np.ndarray, at: np.ndarray, names: dict[str, float]) -> list[np.ndarray]:
        """What the shards hold for the pairs ``at``: an array per name, with the given value
        where a pair is not kept."""
        out = [np.full(len(at), missing) for missing in names.values()]
        kept = np.flatnonzero(at >= 0)
        for s, mine in _by_shard(home[kept], self.shards):
            arrays, mine = self.shard(s)[1], kept[mine]
            for o, name in zip(out, names):
                o[mine] = decode(arrays[name][at[mine]])
        return out

    def third(self, home: np.ndarray, at: np.ndarray, word: np.ndarray) -> np.ndarray:
        """d(uvw) of each kept pair ``at`` and third word, 0 if it is not kept."""
        out = np.zeros(len(at))
        for s, mine in _by_shard(home, self.shards):
            seqs, arrays = self.shard(s)
            first, end = (x.astype(np.int64) for x in seqs["children"].span(at[mine]))
            some = first < end
            mine, first, end = mine[some], first[some], end[some]
            key = at[mine].astype(np.uint64) * np.uint64(self.words) + word[mine].astype(np.uint64)
            spot = seqs["third"].find(key, first, end)
            hit = spot >= 0
            out[mine[hit]] = decode(arrays["third.d"][spot[hit]])
        return out


# A batch's tokens: every row's words, then its end token.


def _tokens(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, hashes, where each row starts) chunk by chunk."""
    for a, b, w in words_of(column, lower=True):
        yield a, b, np.insert(w.hash, w.at[1:], np.uint64(END)), w.at + np.arange(b - a + 1)


class Lookup:
    """Word ids and counts by hash; a task remembers the words it has met."""

    def __init__(self, vocabulary: Vocabulary, most: int = 1_000_000):
        self.vocabulary, self.most = vocabulary, most
        self.hash, self.id, self.count = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __call__(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        met, back = np.unique(hashes, return_inverse=True)
        fresh = met[absent(met, self.hash)]
        if len(self.hash) + len(fresh) > self.most:
            self.hash, self.id, self.count, fresh = self.hash[:0], self.id[:0], self.count[:0], met
        if len(fresh):
            ids = self.vocabulary.ids(fresh)
            counts = np.zeros(len(ids), np.int64)
            counts[ids >= 0] = self.vocabulary.counts(ids[ids >= 0])
            order = np.argsort(np.concatenate([self.hash, fresh]), kind="stable")
            self.hash = np.concatenate([self.hash, fresh])[order]
            self.id, self.count = np.concatenate([self.id, ids])[order], np.concatenate([self.count, counts])[order]
        spot = np.searchsorted(self.hash, met)
        return self.id[spot][back], self.count[spot][back]


def _neighbours(at: np.ndarray, n: int, back: int) -> np.ndarray:
    """Which tokens have ``back`` tokens of their row before them."""
    return np.arange(n) - np.repeat(at[:-1], np.diff(at)) >= back


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return left.astype(np.uint64) << _SHIFT | right.astype(np.uint64)


def _merged(parts: list[tuple[np.ndarray, ...]]) -> list[np.ndarray]:
    """Rows of equal keys (all columns but the last) added up. Each part is sorted by its keys,
    which do not repeat in it; keys after the first are below 2**32. Stable sorts merge the parts."""
    if len(parts) == 1:
        return [*parts[0]]
    cols = [np.concatenate(c) for c in zip(*parts)]
    key = cols[0]
    order = np.argsort(key, kind="stable")
    for col in cols[1:-1]:
        new = np.zeros(len(order), np.uint64)
        new[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(len(order), np.uint64)
        rank[order] = np.cumsum(new, dtype=np.uint64)
        key = rank << _SHIFT | col.astype(np.uint64)
        order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else order
    sums = np.add.reduceat(cols[-1][order], first) if len(first) else cols[-1]
    return [*(c[order[first]] for c in cols[:-1]), sums]


def _counted(docs: DataFrame, names: list[str], emit) -> DataFrame:
    """Sums of what ``emit(column)`` yields: key columns and a count."""
    schema = pa.schema([(n, pa.int64()) for n in [*names, "c"]])

    def out(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
        cols = _merged(parts)
        return pa.RecordBatch.from_arrays([pa.array(c.astype(np.uint64).view(np.int64)) for c in cols], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = emit()
        for batch in batches:
            parts, rows = [], 0
            for part in each(batch.column(0)):
                parts.append(part)
                rows += len(part[0])
                if rows > MERGED_ROWS:
                    yield out(parts)
                    parts, rows = [], 0
            if parts:
                yield out(parts)

    rows = docs.select("text").mapInArrow(run, ", ".join(f"{n} long" for n in [*names, "c"]))
    # Tasks have added up what they hold: adding up again before the shuffle would find little.
    return rows.repartition(*names).groupBy(*names).agg(F.sum("c").alias("c"))


def _shard_bits(entries: int) -> int:
    return max(0, (entries // SHARD_ENTRIES).bit_length())


def _save_shards(rows: DataFrame, key: str, order: list[str], build) -> None:
    """Run ``build(shard, columns)`` once for each shard, in a task, on its sorted rows; the
    shards are as many as entries ask for, so each is of a bounded size."""
    cols = rows.columns

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in order])
        shard = table[key][0].as_py()
        build(shard, {c: table[c].to_numpy() for c in cols if c != key})
        return pa.table({"shard": pa.array([shard], pa.int64())})

    rows.groupBy(key).applyInArrow(run, "shard long").count()


class NgramModel:
    """Fit with ``train``; score with ``score``. The files stay in the shared folder."""

    def __init__(self, vocabulary: Vocabulary, pairs: Pairs, least: int):
        self.vocabulary, self.pairs, self.least = vocabulary, pairs, least

    @classmethod
    def train(cls, texts: DataFrame, least: int = 2, discount: float = 0.75) -> NgramModel:
        """``texts`` has a column ``text``."""
        folder = f"{shared_dir(texts.sparkSession)}/ngrams-{uuid.uuid4().hex}"

        # Level 1.
        def words():
            def each(column):
                for _, _, hashes, _ in _tokens(column):
                    value, n = np.unique(hashes, return_counts=True)
                    yield value, n

            return each

        unigrams = written(_counted(texts, ["h"], words))
        size, total = unigrams.agg(F.count(F.lit(1)), F.coalesce(F.sum("c"), F.lit(0))).first()
        if size >= 1 << 32:
            raise ValueError("more than 2**32 different words")
        bits = _shard_bits(size)
        home = F.shiftrightunsigned("h", 64 - bits) if bits else F.lit(0).cast("long")
        unigrams = unigrams.withColumn("shard", home.cast("long"))
        held = {r.shard: r.n for r in unigrams.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a shard
        base = np.concatenate([[0], np.cumsum([held.get(s, 0) for s in range(1 << bits)])]).astype(np.int64)
        rest = 64 - bits

        def save_words(shard, cols, extra=None):
            h = cols["h"].view(np.uint64)
            order = np.argsort(h)
            key = h[order] & np.uint64((1 << rest) - 1)
            arrays = named("hash", EliasFano.build(key, 1 << rest)) | {"count": cols["c"][order]}
            if "kept" in cols:
                arrays["backoff"] = encode(1 - np.nan_to_num(cols["kept"][order].astype(float)) / cols["c"][order])
            save(f"{folder}/{'b' if 'kept' in cols else 'a'}/words-{shard}", arrays)

        _save_shards(unigrams.select("shard", "h", "c"), "shard", ["h"], save_words)
        vocabulary = Vocabulary(f"{folder}/a", bits, base, int(total))

        # Level 2: pairs of words that occur often enough.
        def pairs():
            look = Lookup(vocabulary)

            def each(column):
                for _, _, hashes, at in _tokens(column):
                    ids, counts = look(hashes)
                    ok = _neighbours(at, len(ids), 1)[1:] & (counts[1:] >= least) & (counts[:-1] >= least)
                    value, n = np.unique(_pair(ids[:-1][ok], ids[1:][ok]), return_counts=True)
                    yield value, n

            return each

        bigrams = written(_counted(texts, ["pair"], pairs).filter(F.col("c") >= least))
        n_pairs = bigrams.count()
        shards = n_pairs // SHARD_ENTRIES | 1  # odd, or the remainder would not see the context

        def with_home(rows):
            return rows.withColumn("shard", F.pmod("pair", F.lit(shards)))

        def level2(cols, order):
            pair = cols["pair"].view(np.uint64)[order]
            context, first = np.unique(pair >> _SHIFT, return_index=True)
            place = np.repeat(np.arange(len(context)), np.diff(np.append(first, len(pair)))).astype(np.uint64)
            keys = place * np.uint64(vocabulary.size) + (pair & np.uint64(0xFFFFFFFF))
            arrays = named("context", EliasFano.build(context, vocabulary.size))
            arrays |= named("first", EliasFano.build(np.append(first, len(pair)), len(pair) + 1))
            return arrays | named("word", EliasFano.build(keys, len(context) * vocabulary.size))

        def save_pairs(shard, cols):
            save(f"{folder}/a/pairs-{shard}", level2(cols, np.argsort(cols["pair"].view(np.uint64))))

        _save_shards(with_home(bigrams.select("pair")), "shard", ["pair"], save_pairs)
        kept = Pairs(f"{folder}/a", shards, vocabulary.size)

        # Level 3: triples both of whose pairs are kept.
        def triples():
            look = Lookup(vocabulary)

            def each(column):
                for _, _, hashes, at in _tokens(column):
                    ids, counts = look(hashes)
                    ok = _neighbours(at, len(ids), 1)[1:] & (counts[1:] >= least) & (counts[:-1] >= least)
                    spot = np.flatnonzero(ok)
                    pair, back = np.unique(_pair(ids[spot], ids[spot + 1]), return_inverse=True)
                    there = np.zeros(len(ids) + 1, bool)
                    there[spot] = (kept.find(pair)[1] >= 0)[back]
                    t = np.flatnonzero(there[:-1] & there[1:])
                    # A pair's place among those of the chunk and the third word are one number.
                    place = np.zeros(len(ids), np.uint64)
                    place[spot] = back
                    value, n = np.unique(place[t] << _SHIFT | ids[t + 2].astype(np.uint64), return_counts=True)
                    yield pair[(value >> _SHIFT).astype(np.int64)], (value & np.uint64(0xFFFFFFFF)).astype(np.int64), n

            return each

        trigrams = written(_counted(texts, ["pair", "third"], triples).filter(F.col("c") >= least))

        # Back-off weights and the finished files.
        left = trigrams.groupBy("pair").agg(
            F.sum(F.col("c") - discount).alias("kept"), F.count(F.lit(1)).alias("n_third")
        )
        bigrams = written(bigrams.join(left, "pair", "left"))
        context = F.shiftrightunsigned("pair", 32)
        left = bigrams.groupBy(context.alias("id")).agg(F.sum(F.col("c") - discount).alias("kept"))

        def to_hash(batches):
            for batch in batches:
                ids = batch.column(0).to_numpy()
                out = np.zeros(len(ids), np.uint64)
                shard = np.searchsorted(base, ids, "right") - 1
                for s in np.unique(shard):
                    mine = shard == s
                    top = np.uint64(int(s) << rest) if bits else np.uint64(0)
                    out[mine] = vocabulary.shard(int(s))[0].value(ids[mine] - base[s]) | top
                yield pa.RecordBatch.from_arrays([pa.array(out.view(np.int64)), batch.column(1)], names=["h", "kept"])

        left = left.mapInArrow(to_hash, "h long, kept double")
        _save_shards(unigrams.join(left, "h", "left").select("shard", "h", "c", "kept"), "shard", ["h"], save_words)

        def save_trie(shard, cols):
            """Rows of both levels: a pair has no third word, a triple one."""
            level = np.isnan(cols["third"].astype(float)) if cols["third"].dtype != np.int64 else np.zeros(len(cols["pair"]), bool)
            two = {c: cols[c][level] for c in cols}
            order = np.argsort(two["pair"].view(np.uint64))
            arrays = level2(two, order)
            pair, count = two["pair"].view(np.uint64)[order], two["c"][order]
            arrays["word.d"] = encode((count - discount) / vocabulary.counts((pair >> _SHIFT).astype(np.int64)))
            arrays["word.backoff"] = encode(1 - np.nan_to_num(two["kept"][order].astype(float)) / count)
            up, third, c = cols["pair"].view(np.uint64)[~level], cols["third"][~level].astype(np.uint64), cols["c"][~level]
            parent = np.searchsorted(pair, up)
            order = np.lexsort((third, parent))
            parent, third, c = parent[order], third[order], c[order]
            start = np.searchsorted(parent, np.arange(len(pair) + 1))
            arrays |= named("children", EliasFano.build(start, len(parent) + 1))
            keys = parent.astype(np.uint64) * np.uint64(vocabulary.size) + third
            arrays |= named("third", EliasFano.build(keys, len(pair) * vocabulary.size))
            arrays["third.d"] = encode((c - discount) / count[parent])
            save(f"{folder}/b/pairs-{shard}", arrays)

        both = bigrams.select("pair", F.lit(None).cast("long").alias("third"), "c", "kept").unionByName(
            trigrams.select("pair", "third", "c", F.lit(None).cast("double").alias("kept"))
        )
        _save_shards(with_home(both), "shard", ["pair"], save_trie)
        return cls(Vocabulary(f"{folder}/b", bits, base, int(total)), Pairs(f"{folder}/b", shards, int(size)), least)

    def probabilities(self, look: Lookup, hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """p(token | up to two before it in its row), the token's own p, and its count."""
        ids, counts = look(hashes)
        own = self.vocabulary.base_p(counts)
        p = own.copy()
        n = len(ids)
        one = np.flatnonzero(_neighbours(at, n, 1) & (np.concatenate([[-1], ids[:-1]]) >= 0))
        if not len(one):
            return p, own, counts
        context, back = np.unique(ids[one - 1], return_inverse=True)
        p[one] = self.vocabulary.backoff(context)[back] * own[one]
        # A kept pair is made of words, and a kept triple of pairs, that are kept.
        known = one[(counts[one] >= self.least) & (counts[one - 1] >= self.least)]
        pair, back = np.unique(_pair(ids[known - 1], ids[known]), return_inverse=True)
        home, spot = self.pairs.find(pair)
        d, backoff = self.pairs.values(home, spot, {"word.d": 0.0, "word.backoff": 1.0})
        p[known] += d[back]
        weight = np.ones(n)
        weight[known] = backoff[back]
        place, shard = np.full(n, -1), np.zeros(n, np.int64)
        place[known], shard[known] = spot[back], home[back]
        two = np.flatnonzero(_neighbours(at, n, 2) & (np.concatenate([[-1], place[:-1]]) >= 0))
        p[two] *= weight[two - 1]
        two = two[place[two] >= 0]
        p[two] += self.pairs.third(shard[two - 1], place[two - 1], ids[two])
        return p, own, counts

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """doc_id, n_tokens, n_known, train_tokens, base_score, score (log10)."""
        schema = pa.schema(
            [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()),
             ("base_score", pa.float64()), ("score", pa.float64())]
        )

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            look = Lookup(self.vocabulary)
            for batch in batches:
                cols: list[list[np.ndarray]] = [[], [], [], [], []]
                for a, b, hashes, at in _tokens(batch.column(1)):
                    p, own, counts = self.probabilities(look, hashes, at)
                    for c, v in zip(
                        cols,
                        (np.diff(at), np.add.reduceat((counts > 0).astype(np.int64), at[:-1]), np.full(b - a, self.vocabulary.total),
                         np.add.reduceat(np.log10(own), at[:-1]), np.add.reduceat(np.log10(p), at[:-1])),
                    ):
                        c.append(v)
                done = [np.concatenate(c) if c else np.zeros(0) for c in cols]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *(pa.array(c, f.type) for c, f in zip(done, list(schema)[1:]))], schema=schema
                )

        rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
        return rows.mapInArrow(
            run, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"
        )


def score_held_out(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """Scores of all rows by a model of those outside the held-out fold."""
    texts = docs.filter(~held_out(F.col(id_col))).select(F.col(text_col).cast("string").alias("text"))
    scores = NgramModel.train(texts, **how).score(docs, id_col, text_col)
    return scores.withColumn("held_out", held_out(F.col("doc_id")))
