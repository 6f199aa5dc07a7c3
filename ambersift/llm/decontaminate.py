"""Benchmark items inside documents, found by embedded edit distance.

Candidate windows have the size of an item. A CGK random walk embeds a window (and an
item) so that few edits change few places: at each step the current word is written
down and a random bit of (step, word) says whether to go on to the next word. Sampling
places of the embedding is then a locality-sensitive hash for edit distance; it is
repeated with other walks, as often as the recall asked for takes at an item's size and
full edit budget (``repeats_for`` measures it on edited random words). Windows and items that agree in a
repetition are compared exactly: edit distance in words between the item and the best
stretch of the window and its surroundings.

Embedding every window of a corpus would cost far more than reading it, so windows start
where q-grams of items of their size say: each hit puts the item's start at its place in
the text less its place in the item, and as many hits as an item with the allowed edits
keeps must agree on the start up to those edits. No occurrence within the edits is left
out by this, also not where items lie in one another. Hits pass a bit table first, which
grows with the number of q-grams.

* Words are runs of letters and digits (anything but blanks and ASCII punctuation), lower
  case. Null and empty texts have none.
* Items of fewer than ``min_words`` words identify nothing and are left out.
* Items with equal words are searched once, under the smallest id.
* Repeated rows give one result; an empty table on either side gives an empty result;
  other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import slice_count, written
from .tables import free, join_counted
from .words import Words, mix, rolling, row_chunks, table, text_bytes, whole

TABLE_BITS = 22  # of the bit table at least; at most 1 in 16 of its bits are set
PAIRS = 1 << 21  # pairs of a text's and an item's q-gram worked on at once
SLICE = 1 << 22  # q-grams of items that a task holds
PROBES, WALKS = 48, 64  # random items and walks by which repetitions are measured
_SPREAD = np.arange(256, dtype=np.uint8)
_SPREAD[table(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")] = 32


def plain_words(column: pa.Array) -> Iterator[tuple[int, int, Words]]:
    data, at = text_bytes(pc.utf8_lower(pc.fill_null(column, "")))
    for a, b in row_chunks(at):
        yield a, b, Words(_SPREAD[data[at[a] : at[b]]], at[a : b + 1] - at[a])


def allowed(n: int, share: float) -> int:
    return math.floor(share * n + 1e-9)


def gram_rule(n: int, share: float) -> tuple[int, int]:
    """Longest q-gram (3 at most), and how many of them an item of ``n`` words keeps under
    the allowed edits, each of which breaks at most ``q``."""
    e = allowed(n, share)
    for q in (3, 2):
        if n - q + 1 - q * e >= 1:
            return q, n - q + 1 - q * e
    return 1, max(1, n - e)


def _items(benchmark: DataFrame, id_col: str, text_col: str, share: float, min_words: int) -> DataFrame:
    """item_id, n, words (32-bit hashes), grams (hashes of its q-grams in order)."""
    schema = pa.schema([("item_id", pa.int64()), ("n", pa.int32()), ("words", pa.binary()), ("grams", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), []
            for a, b, w in plain_words(batch.column(1)):
                h = w.hash
                for k in range(b - a):
                    own = h[w.at[k] : w.at[k + 1]]
                    if len(own) >= min_words:
                        q, _ = gram_rule(len(own), share)
                        grams = rolling(own, q).view(np.int64).tolist()
                        rows.append((ids[a + k], len(own), own.astype(np.uint32).tobytes(), grams))
            cols = list(zip(*rows)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    rows = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).cast("string").alias("text"))
    items = rows.mapInArrow(run, "item_id long, n int, words binary, grams array<long>")
    return items.groupBy("n", "words").agg(F.min("item_id").alias("item_id"), F.first("grams").alias("grams"))


class Places:
    """Where q-grams stand in items: a bit table, then the (size, place) pairs of a q-gram."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, j: np.ndarray, q: int, share: float):
        order = np.lexsort((j, n, gram))
        gram, n, j = gram[order], n[order], j[order]
        self.q = q
        self.known, first = np.unique(gram, return_index=True)
        self.first = np.append(first, len(gram))
        self.sizes, self.size = np.unique(n, return_inverse=True)
        self.size, self.j = self.size.astype(np.int32), j.astype(np.int32)
        self.edits = np.array([allowed(int(x), share) for x in self.sizes])
        self.need = np.array([gram_rule(int(x), share)[1] for x in self.sizes])
        size = max(TABLE_BITS, (16 * len(self.known) - 1).bit_length())
        self.shift = np.uint64(64 - size)
        bits = np.zeros(1 << size, bool)
        bits[(self.known >> self.shift).astype(np.int64)] = True
        self.packed = np.packbits(bits)

    def windows(
        self, at: np.ndarray, rows: np.ndarray, h: np.ndarray, bits: np.ndarray
    ) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Rows, first words in the row (below 0 if the item would start before it) and sizes.

        An item with at most ``e`` edits keeps ``need`` q-grams, and their places in the
        text less those in the item differ by ``e`` at most. Each such difference of a
        band with ``need`` hits is a window's start."""
        grams = rolling(h, self.q)
        p = np.flatnonzero(bits[(grams >> self.shift).astype(np.int64)] & whole(at, self.q, len(h)))
        k = np.minimum(np.searchsorted(self.known, grams[p]), len(self.known) - 1)
        same = self.known[k] == grams[p]
        p, k = p[same], k[same]
        row, most = rows[p], int(self.sizes.max())
        count = self.first[k + 1] - self.first[k]
        total = np.concatenate([[0], np.cumsum(count)])
        wide = int(np.diff(at).max(initial=0)) + 2 * most + 1
        a = 0
        while a < len(p):
            b = max(a + 1, int(np.searchsorted(total, total[a] + PAIRS, "right")) - 1)
            if b < len(p) and row[b] == row[b - 1]:  # a row's hits stay together
                b = int(np.searchsorted(row, row[b]))
                b = b if b > a else int(np.searchsorted(row, row[a], "right"))
            n = count[a:b]
            entry = np.repeat(self.first[k[a:b]] - total[a:b], n) + np.arange(total[a], total[b])
            start = np.repeat(p[a:b] - at[row[a:b]], n) - self.j[entry]
            own = np.repeat(row[a:b] - row[a], n)
            held = int(row[b - 1] - row[a]) + 1
            c = np.sort((self.size[entry] * held + own) * wide + start + most)
            size = c // (held * wide)
            end = np.searchsorted(c, c + self.edits[size], "right")
            full = np.flatnonzero(end - np.arange(len(c)) >= self.need[size])
            edge = np.zeros(len(c) + 1, np.int64)
            np.add.at(edge, full, 1)
            np.add.at(edge, end[full], -1)
            c = np.unique(c[np.cumsum(edge[:-1]) > 0])
            if len(c):
                yield c // wide % held + row[a], c % wide - most, c // (held * wide)
            a = b


def _windows(docs: DataFrame, places: list[Places]) -> DataFrame:
    """Windows that may hold an item: where (document, text hash, first word), their size,
    the words with ``lead`` words before and as many as edits may add after. A window that
    starts before its text has a start and a lead below 0."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("lead", pa.int32()),
         ("wh", pa.int64()), ("region", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.unpackbits(x.packed).astype(bool) for x in places]
        for batch in batches:
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, _, w in plain_words(batch.column(2)):
                h = w.hash
                small, rows_of = h.astype(np.uint32), w.row
                for x, bits in zip(places, tables):
                    for row, start, size in x.windows(w.at, rows_of, h, bits):
                        n, e = x.sizes[size], x.edits[size]
                        first, last = w.at[row], w.at[row + 1]
                        at = first + start
                        # Where an item would begin before its text or end after it, what there is of it.
                        lo, hi = np.maximum(first, at - e), np.minimum(last, at + n + e)
                        begin, end = np.maximum(first, at), np.minimum(last, at + n)
                        key = np.zeros(len(at), np.uint64)
                        for size in np.unique(end - begin):
                            mine = end - begin == size
                            key[mine] = rolling(h, int(size))[begin[mine]]
                        key = mix(mix(key + n.astype(np.uint64)) + (begin - at).astype(np.uint64))
                        for b in range(0, len(at), 8192):
                            part = slice(b, b + 8192)
                            r = (row[part] + a).tolist()
                            cols = [
                                [ids[i] for i in r], [hashes[i] for i in r], start[part], n[part], (at - lo)[part],
                                key[part].view(np.int64), [small[y:z].tobytes() for y, z in zip(lo[part], hi[part])],
                            ]
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    return docs.mapInArrow(run, "doc_id long, text_hash long, start int, n int, lead int, wh long, region binary")


def _proposed(rows: DataFrame, items: DataFrame, share: float) -> DataFrame:
    """Windows of all items; those of a large benchmark go in slices of a bounded size, with
    all q-grams of an item in one slice and one pass over the texts for each."""
    slices = max(1, -(-(items.agg(F.sum(F.size("grams"))).first()[0] or 0) // SLICE))
    out = None
    for k in range(slices):
        mine = items.filter(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == k)
        seeds = mine.select("n", F.posexplode("grams").alias("j", "gram")).distinct().toPandas()
        gram, n, j = seeds["gram"].to_numpy(np.int64).view(np.uint64), seeds["n"].to_numpy(), seeds["j"].to_numpy()
        q = np.array([gram_rule(int(x), share)[0] for x in n], np.int64)
        places = [Places(gram[q == x], n[q == x], j[q == x], int(x), share) for x in np.unique(q)]
        part = written(_windows(rows, places))
        out = part if out is None else out.unionByName(part)
    return out


def padded(region: np.ndarray, lead: int, n: int) -> np.ndarray:
    """The ``n`` words from ``lead`` on, each plus one; 0 stands for those that ``region`` lacks."""
    out = np.zeros(n, np.uint64)
    own = region[max(lead, 0) : lead + n].astype(np.uint64) + np.uint64(1)
    out[max(-lead, 0) :][: len(own)] = own
    return out


def lsh_keys(words: list[np.ndarray], repeats: int, places: int) -> np.ndarray:
    """One key per row and repetition: the words at sampled places of the row's CGK walk."""
    n = np.array([len(x) for x in words])
    m = int(n.max(initial=0))
    grid = np.zeros((len(words), m + 1), np.uint64)  # past the end stands 0
    grid[np.arange(m + 1) < n[:, None]] = np.concatenate(words)
    rows, out = np.arange(len(words)), np.zeros((len(words), repeats), np.uint64)
    for r in range(repeats):
        rng = np.random.default_rng(r)
        wanted = (rng.random(places) * 2 * n[:, None]).astype(np.int64)
        coins = mix(grid + np.uint64((r + 1) * 0x632BE59BD9B4E019 & (1 << 64) - 1))
        key, at = mix(n.astype(np.uint64) + np.uint64(r << 32)), np.zeros(len(words), np.int64)
        for t in range(int(wanted.max(initial=-1)) + 1):
            if t and t % 64 == 0:
                coins = mix(coins)
            for p in range(places):
                now = wanted[:, p] == t
                if now.any():
                    # A sum, so that the order in which places are met does not matter.
                    key[now] += mix(grid[rows[now], at[now]] + np.uint64((p + 1) << 40))
            step = (coins[rows, at] >> np.uint64(t % 64)) & np.uint64(1)
            at = np.minimum(at + step.astype(np.int64), n)
        out[:, r] = mix(key)
    return out


def repeats_for(n: int, share: float, places: int, recall: float, kind: int) -> int:
    """Repetitions after which ``recall`` of the items of ``n`` words agree with one of their
    windows at the full edit budget, for substituted (``kind`` 0), inserted or deleted words.

    Each of ``PROBES`` random items has its own chance to agree, estimated from ``WALKS``
    walks."""
    e, rng = allowed(n, share), np.random.default_rng(4 * n + kind)
    if not e:
        return 1
    q, _ = gram_rule(n, share)
    items, texts = [], []
    for _ in range(PROBES):
        w, new, before, after = rng.integers(1, 1 << 32, (4, n), dtype=np.uint64)
        at = np.sort(rng.choice(n, e, replace=False))
        if kind == 0:
            own = w.copy()
            own[at] = new[at]
        elif kind == 1:
            own = np.insert(w, at, new[:e])
        else:
            own = np.delete(w, at)
        items.append(w)
        texts.append(np.concatenate([before, own, after]))
    grams = np.concatenate([rolling(w, q) for w in items])
    found = Places(grams, np.full(len(grams), n), np.tile(np.arange(n - q + 1), PROBES), q, share)
    size, h = len(texts[0]), np.concatenate(texts)
    at = np.arange(PROBES + 1) * size
    got = list(found.windows(at, np.repeat(np.arange(PROBES), size), h, np.unpackbits(found.packed).astype(bool)))
    if not got:  # no word need be left
        return 1
    row, start = (np.concatenate([x[k] for x in got]) for k in (0, 1))
    near = [padded(texts[r].astype(np.uint32), x, n) for r, x in zip(row.tolist(), start.tolist())]
    keys = lsh_keys([padded(w.astype(np.uint32), 0, n) for w in items] + near, WALKS, places)
    agree = np.zeros((PROBES, WALKS), bool)
    np.logical_or.at(agree, row, keys[PROBES:] == keys[row])
    # Half a hit for no hit: a chance is never taken for none.
    miss, low, high = 1 - np.clip(agree.mean(1), 0.5 / WALKS, 1), 0, 1
    while (1 - miss**high).mean() < recall:
        low, high = high, 2 * high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (low, mid) if (1 - miss**mid).mean() >= recall else (mid, high)
    return high


def _repeats(spark: SparkSession, lengths: list[int], share: float, places: int, recall: float) -> dict[int, int]:
    """Repetitions by item size, the most that any kind of edit needs; measured in tasks, at
    every quarter of a power of two."""
    up = {n: -(-n // step) * step for n in lengths for step in [max(1, 1 << max(0, n.bit_length() - 3))]}
    jobs = [(size, kind) for size in sorted(set(up.values())) for kind in range(3)]
    schema = pa.schema([("size", pa.int32()), ("need", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                size, kind = jobs[k]
                need = repeats_for(size, share, places, recall, kind)
                yield pa.RecordBatch.from_arrays([pa.array([size], pa.int32()), pa.array([need], pa.int32())], schema=schema)

    if not jobs:
        return {}
    rows = spark.range(0, len(jobs), 1, len(jobs)).mapInArrow(run, "size int, need int")
    need = {r.size: r.need for r in rows.groupBy("size").agg(F.max("need").alias("need")).collect()}
    return {n: need[size] for n, size in up.items()}


def _keys(rows: DataFrame, repeats: dict[int, int], places: int, name: str, kind: str) -> DataFrame:
    """(``name``, key) for all repetitions of a size; ``rows`` has ``name``, lead, n and region."""
    schema = pa.schema([(name, pa.int64()), ("key", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                who, lead, n, region = (c.to_pylist() for c in part.columns)
                often = np.array([repeats[k] for k in n])
                for r in np.unique(often).tolist():
                    mine = np.flatnonzero(often == r).tolist()
                    words = [padded(np.frombuffer(region[i], np.uint32), lead[i], n[i]) for i in mine]
                    keys = lsh_keys(words, r, places).view(np.int64)
                    own = np.repeat(np.array([who[i] for i in mine], np.int64), r)
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(keys.ravel())], schema=schema)

    return rows.select(name, "lead", "n", "region").mapInArrow(run, f"{name} {kind}, key long")


def infix_distance(items: list[np.ndarray], regions: list[np.ndarray]) -> np.ndarray:
    """Edit distance in words between each item and the best stretch of its region."""
    n, m = np.array([len(x) for x in items]), np.array([len(x) for x in regions])
    a = np.full((len(items), n.max(initial=0)), -1, np.int64)
    b = np.full((len(items), m.max(initial=0)), -2, np.int64)
    a[np.arange(a.shape[1]) < n[:, None]] = np.concatenate(items)
    b[np.arange(b.shape[1]) < m[:, None]] = np.concatenate(regions)
    col = np.arange(b.shape[1] + 1)
    prev = np.zeros((len(items), b.shape[1] + 1), np.int64)  # a stretch may start anywhere
    out = np.zeros(len(items), np.int64)
    for i in range(a.shape[1]):
        now = np.empty_like(prev)
        now[:, 0] = i + 1
        now[:, 1:] = np.minimum(prev[:, :-1] + (a[:, i : i + 1] != b), prev[:, 1:] + 1)
        prev = np.minimum.accumulate(now - col, axis=1) + col
        done = n == i + 1
        if done.any():
            out[done] = np.where(col <= m[done][:, None], prev[done], n[done][:, None]).min(1)
    return out


def _verify(rows: DataFrame, share: float) -> DataFrame:
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("item_id", pa.int64()), ("edits", pa.int32()),
         ("start", pa.int32()), ("n_words", pa.int32())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 1024):
                part = batch.slice(a, 1024)
                item = [np.frombuffer(x, np.uint32).astype(np.int64) for x in part.column(4).to_pylist()]
                region = [np.frombuffer(x, np.uint32).astype(np.int64) for x in part.column(5).to_pylist()]
                n = np.array([len(x) for x in item])
                d = infix_distance(item, region)
                ok = pa.array(d <= np.floor(share * n + 1e-9))
                got = [part.column(0), part.column(1), part.column(2), pa.array(d, pa.int32()), part.column(3), pa.array(n, pa.int32())]
                yield pa.RecordBatch.from_arrays([c.filter(ok) for c in got], schema=schema)

    cols = rows.select("doc_id", "text_hash", "item_id", "start", "words", "region")
    return cols.mapInArrow(run, "doc_id long, text_hash long, item_id long, edits int, start int, n_words int")


def find_items(
    docs: DataFrame, benchmark: DataFrame, share: float = 0.2, recall: float = 0.995, places: int = 2, min_words: int = 5,
    id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """One row for each text and benchmark item in it: doc_id, text_hash, item_id, edits (in
    words, at most ``share`` of the item's), start (word of the window) and n_words. Of the
    items at the full edit budget ``recall`` are found, of others more."""
    spark = docs.sparkSession
    items = written(_items(benchmark, item_col, item_text, share, min_words))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    windows = _proposed(rows, items, share)
    lengths = [r.n for r in items.select("n").distinct().orderBy("n").collect()]  # at most the longest item's words
    repeats = _repeats(spark, lengths, share, places, recall)

    # Equal windows are embedded once; a passage that a third of the documents share is one row here.
    counts = windows.groupBy("wh").agg(F.count(F.lit(1)).alias("n_rows"))
    distinct = windows.select("wh", "lead", "n", "region").dropDuplicates(["wh"]).repartition(slice_count(spark), "wh")
    keys = _keys(distinct, repeats, places, "wh", "long")
    item_rows = items.select("item_id", F.lit(0).alias("lead"), "n", F.col("words").alias("region"))
    met = keys.join(_keys(item_rows, repeats, places, "item_id", "long"), "key").select("wh", "item_id").distinct()
    met = written(met.join(counts, "wh"))
    # With several items for one window its rows count once for each.
    pairs = join_counted(windows.select("doc_id", "text_hash", "start", "wh", "region"), _lists(met), "wh", "n_rows")
    pairs = pairs.withColumn("item_id", F.explode("item_ids")).join(items.select("item_id", "words"), "item_id")
    found = _verify(pairs, share).groupBy("doc_id", "text_hash", "item_id")
    found = found.agg(F.min(F.struct("edits", F.greatest("start", F.lit(0)).alias("start"), "n_words")).alias("best"))
    return found.select("doc_id", "text_hash", "item_id", "best.edits", "best.start", "best.n_words")


def _lists(met: DataFrame) -> DataFrame:
    """One row per window with the items it met: items with equal words are one, so the
    list holds different near items only."""
    return written(met.groupBy("wh").agg(F.collect_set("item_id").alias("item_ids"), F.max("n_rows").alias("n_rows")))


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how
) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item."""
    key, own = free(docs, "leak_id"), free(docs, "leak_hash")
    found = find_items(docs, benchmark, id_col=id_col, text_col=text_col, **how)
    found = found.select(F.col("doc_id").alias("bad_id"), F.col("text_hash").alias("bad_hash")).distinct()
    rows = docs.withColumn(key, F.col(id_col).cast("long")).withColumn(
        own, F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    )
    same = rows[key].eqNullSafe(found["bad_id"]) & (rows[own] == found["bad_hash"])
    return rows.join(found, same, "left_anti").select(*docs.columns)
