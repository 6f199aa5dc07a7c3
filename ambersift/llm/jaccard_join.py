"""Near copies by a chosen-path join on five-word shingles.

Documents with equal shingle sets form a class; one set of a class takes part. A set is
embedded as 64 min-hash tokens. Each run starts from one bucket that holds everything
and splits it by sampled positions: a set goes to the child named by its token there, so
two sets follow each other with the probability of their similarity. A bucket is split
until it is small enough for brute force; one that hardly shrinks when it is split is
full of similar sets and is compared as it is, block by block, so nothing is dropped
and no task grows with it. (The exact links of n different near copies take n * n
comparisons by any method.) Two positions are
sampled per bucket: at the least similarity a pair is lost in one run with the
probability that such a branching process dies out, at any depth, and the number of
runs follows from the recall asked for.

A pair that meets in several buckets is judged in one, the smallest common one, which
both sides know from the list of their buckets. Judging is exact, on the shingles
themselves. Buckets return one row per member, with its number of links and one edge
to its local group, never the pairs; groups are connected components of these edges.

* Words are runs of other than blank, tab and line ends, A-Z in lower case. A text of one
  to four words has a single shingle. Null, empty and blank texts have none, are linked
  to nothing and are groups of their own.
* Rows with equal texts or equal sets are copies: same class, same group, same links.
* The group's id is its smallest document id. Rows without an id take no part: their
  ids and group are null, links 0.
* An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import slice_count, written
from .groups import components, whole_groups
from .tables import free, join_counted
from .words import Words, mix, rolling, words_of

TOKENS = 64
SAMPLED = 2


def loss_per_run(least: float, sampled: int = SAMPLED) -> float:
    """Chance that a pair of similarity ``least`` never meets in one run, however deep:
    the smallest fixed point of the branching process."""
    q = 0.0
    for _ in range(10_000):
        q = (1 - least + least * q) ** sampled
    return q


def runs_for(least: float, recall: float) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(loss_per_run(least))))


def shingles(w: Words, size: int) -> list[np.ndarray]:
    """Distinct shingle hashes of each row, sorted."""
    h = w.hash
    hashes = rolling(h, size)
    counts = np.diff(w.at)
    short = {}
    for n in range(1, size):
        rows = np.flatnonzero(counts == n)
        if len(rows):
            own = rolling(h, n)
            short.update((int(r), own[w.at[r] : w.at[r] + 1]) for r in rows)
    out = []
    for r in range(len(counts)):
        if counts[r] >= size:
            a, b = w.at[r], w.at[r + 1] - size + 1
            out.append(np.unique(hashes[a:b]))
        else:
            out.append(short.get(r, np.zeros(0, np.uint64)))
    return out


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    n = np.arange(1, 2 * TOKENS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(n[:TOKENS]) | np.uint64(1), mix(n[TOKENS:])


def tokens(sets: list[np.ndarray]) -> np.ndarray:
    """Min-hash tokens (32 bits) of non-empty sets, one row each."""
    out = np.zeros((len(sets), TOKENS), np.uint32)
    if not sets:
        return out
    flat = np.concatenate(sets)
    first = np.cumsum([0] + [len(s) for s in sets[:-1]])
    for k, (a, b) in enumerate(zip(*_seeds())):
        out[:, k] = np.minimum.reduceat((flat * a + b) >> np.uint64(32), first)
    return out


def _print(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _sets(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, text_hash, fp (of the shingle set, null if empty), n (its size), sig (tokens)."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("text_hash", pa.int64()), ("fp", pa.binary()), ("n", pa.int64()), ("sig", pa.binary())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps, counts, sigs = [], [], []
            for _, _, w in words_of(batch.column(1), lower=True):
                sets = shingles(w, size)
                rows = iter(tokens([s for s in sets if len(s)]))
                for s in sets:
                    fps.append(_print(s) if len(s) else None)
                    counts.append(len(s))
                    sigs.append(next(rows).tobytes() if len(s) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), pa.array(fps, pa.binary()), pa.array(counts, pa.int64()),
                    pa.array(sigs, pa.binary()),
                ],
                schema=schema,
            )

    return docs.select("doc_id", "text", "text_hash").mapInArrow(run, "doc_id long, text_hash long, fp binary, n long, sig binary")


def _shingle_sets(docs: DataFrame, size: int) -> DataFrame:
    """uid and set of the wanted classes; ``docs`` has doc_id, text and the ``fp`` wanted of it."""
    schema = pa.schema([("uid", pa.int64()), ("items", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            uids, wanted = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            ids, items = [], []
            for a, _, w in words_of(batch.column(1), lower=True):
                for k, s in enumerate(shingles(w, size), a):
                    if len(s) and _print(s) == wanted[k]:
                        ids.append(uids[k])
                        items.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(items, pa.binary())], schema=schema)

    return docs.select("uid", "text", "fp").mapInArrow(run, "uid long, items binary")


_NODE = "uid long, key long, used long, was long"


def _split(nodes: DataFrame, roots: int | None = None) -> DataFrame:
    """Children of every row's bucket: ``SAMPLED`` positions that its path has not used,
    chosen by the bucket's key alone; ``was`` is its size. With ``roots``, the children of
    that many runs' roots."""
    schema = pa.schema([("uid", pa.int64()), ("key", pa.int64()), ("used", pa.int64()), ("was", pa.int64())])

    def children(uid: np.ndarray, key: np.ndarray, used: np.ndarray, was: pa.Array, sig: np.ndarray) -> Iterator[pa.RecordBatch]:
        one, taken = np.uint64(1), used.copy()
        for k in range(SAMPLED):
            at = mix(key + np.uint64(k + 1)) % np.uint64(TOKENS)
            while (hit := (taken >> at) & one == one).any():
                at[hit] = (at[hit] + one) % np.uint64(TOKENS)
            taken |= one << at
            child = mix(mix(key ^ (at + one)) + sig[np.arange(len(uid)), at.astype(np.int64)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(uid), pa.array(child.view(np.int64)), pa.array((used | one << at).view(np.int64)), was], schema=schema
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            uid = batch.column(0).to_numpy()
            sig = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, TOKENS)
            if roots is None:
                key, used = (batch.column(c).to_numpy().view(np.uint64) for c in (2, 3))
                yield from children(uid, key, used, batch.column(4), sig)
            for r in range(roots or 0):
                root = mix(np.full(len(uid), r, np.uint64) + np.uint64(0xC0FFEE))
                yield from children(uid, root, np.zeros(len(uid), np.uint64), pa.nulls(len(uid), pa.int64()), sig)

    cols = ["uid", "sig"] + ([] if roots else ["key", "used", "n"])
    return nodes.select(*cols).mapInArrow(run, _NODE)


def _buckets(sets: DataFrame, runs: int, limit: int, depth: int) -> DataFrame:
    """(uid, key, n) of the buckets in which sets are compared. Buckets of up to four
    times ``limit`` are not worth a split either: they make a few blocks."""
    level, done = written(_split(sets, runs)), None
    large = F.col("n") > 4 * limit
    dense = F.coalesce(2 * F.col("n") > F.col("was"), F.lit(False))
    for d in range(1, depth + 1):
        sizes = written(level.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        here = join_counted(level, sizes, "key", "n")
        more = d < depth and sizes.filter(large).limit(1).count()
        ready = written((here.filter(~large | dense) if more else here).select("uid", "key", "n"))
        done = ready if done is None else done.unionByName(ready)
        if not more:
            break
        big = here.filter(large & ~dense).select("uid", "key", "used", "n")
        level = written(_split(big.join(sets.select("uid", "sig"), "uid")))
    return done


def _pairs(grp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows with equal values of sorted ``grp``, by distance."""
    i = np.arange(len(grp))
    for d in range(1, len(grp)):
        i = i[: np.searchsorted(i, len(grp) - d)]
        i = i[grp[i] == grp[i + d]]
        if not len(i):
            return
        for a in range(0, len(i), 1 << 14):
            yield i[a : a + (1 << 14)], i[a : a + (1 << 14)] + d


def _candidates(t: pa.Table, near: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs to judge in this bucket: enough common tokens, and no smaller bucket in common."""
    grp, key, cross, blk = (t[c].to_numpy() for c in ("grp", "key", "crossed", "blk"))
    sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint32).reshape(-1, TOKENS)
    lists = t["buckets"].combine_chunks()
    n = lists.value_lengths().to_numpy()
    table = np.full((len(n), int(n.max(initial=1))), np.iinfo(np.int64).max)
    table[np.arange(table.shape[1]) < n[:, None]] = lists.flatten().to_numpy()
    left, right = [], []
    for i, j in _pairs(grp):
        ok = (key[i] == key[j]) & (~cross[i] | (blk[i] != blk[j]))
        i, j = i[ok], j[ok]
        ok = (sig[i] == sig[j]).sum(1) >= near
        i, j = i[ok], j[ok]
        # Lists are sorted; the first entry of one that the other has is the smallest common bucket.
        mine, open_ = np.zeros(len(i), bool), np.ones(len(i), bool)
        for c in range(table.shape[1]):
            k = np.flatnonzero(open_)
            if not len(k):
                break
            value = table[i[k], c]
            common = (table[j[k]] == value[:, None]).any(1) & (value != np.iinfo(np.int64).max)
            mine[k[common]] = value[common] == key[i[k[common]]]
            open_[k[common]] = False
        left.append(i[mine])
        right.append(j[mine])
    none = np.zeros(0, np.int64)
    return np.concatenate(left or [none]), np.concatenate(right or [none])


_MEMBER = "grp long, key long, crossed boolean, blk int, uid long"


def _meeting(rows: DataFrame, near: int) -> DataFrame:
    """Members that have a pair to judge, once per bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "grp"):
            i, j = _candidates(t, near)
            who = np.unique(np.concatenate([i, j]))
            if len(who):
                yield from t.select(["grp", "key", "crossed", "blk", "uid"]).take(pa.array(who)).combine_chunks().to_batches()

    return rows.mapInArrow(run, _MEMBER)


def overlap(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections."""
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    flat = np.concatenate(sets)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    item = np.cumsum(new) - 1
    common = np.bincount(item) > 1
    keep = common[item]
    owner, item = owner[keep], (np.cumsum(common) - 1)[item[keep]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for a in range(0, int(common.sum()), 4096):
        lo, hi = np.searchsorted(item, [a, a + 4096])
        part = np.zeros((len(sets), 4096), np.float32)
        part[owner[lo:hi], item[lo:hi] - a] = 1
        out += part @ part.T
    return out


def _judge(rows: DataFrame, near: int, least: float) -> DataFrame:
    """One row per member and bucket: uid, links, and the member its local group is named by."""
    schema = pa.schema([("uid", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, "grp"):
            i, j = _candidates(t, near)
            if not len(i):
                continue
            grp, uid, items = t["grp"].to_numpy(), t["uid"].to_numpy(), t["items"].combine_chunks()
            order = np.argsort(grp[i], kind="stable")
            i, j = i[order], j[order]
            cut = np.flatnonzero(np.diff(grp[i], prepend=grp[i[0]] - 1))
            out_uid, out_links, out_root = [], [], []
            for a, b in zip(cut, np.append(cut[1:], len(i))):
                who, at = np.unique(np.concatenate([i[a:b], j[a:b]]), return_inverse=True)
                x, y = at[: b - a], at[b - a :]
                sets = [np.frombuffer(items[int(k)].as_py(), np.uint64) for k in who]
                size = np.array([len(s) for s in sets])
                both = overlap(sets)[x, y].astype(np.int64)
                ok = both >= least * (size[x] + size[y] - both) - 1e-9
                x, y = x[ok], y[ok]
                if not len(x):
                    continue
                links = np.bincount(np.concatenate([x, y]), minlength=len(who))
                root = np.arange(len(who))
                while True:  # smallest label among linked members, until nothing changes
                    low = root.copy()
                    np.minimum.at(low, x, root[y])
                    np.minimum.at(low, y, root[x])
                    low = low[low]
                    if (low == root).all():
                        break
                    root = low
                seen = np.flatnonzero(links)
                out_uid.append(uid[who[seen]])
                out_links.append(links[seen])
                out_root.append(uid[who[root[seen]]])
            if out_uid:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(c).astype(np.int64)) for c in (out_uid, out_links, out_root)], schema=schema
                )

    return rows.mapInArrow(run, "uid long, links long, root long")


def similar(
    docs: DataFrame, least: float = 0.8, recall: float = 0.999, size: int = 5, limit: int = 1024, depth: int = 8,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """One row per document: doc_id, text_hash, class_id (smallest id of its near-copy group), copy_of
    (smallest id with the same shingles), n_copies (documents with the same shingles) and
    n_links (different shingle sets of similarity ``least`` or more)."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    texts = texts.withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    every = written(_sets(texts, size).withColumn("uid", F.monotonically_increasing_id()))
    whole_sets = every.filter("fp is not null and doc_id is not null")
    classes = written(
        whole_sets.groupBy("fp").agg(F.min("uid").alias("uid"), F.min("doc_id").alias("copy_of"), F.count(F.lit(1)).alias("n"))
    )
    sets = written(classes.select("uid").join(whole_sets.select("uid", "sig"), "uid"))

    # Five standard deviations of the estimate below the least similarity.
    near = math.floor(TOKENS * (least - 5 * math.sqrt(least * (1 - least) / TOKENS)))
    buckets = written(_buckets(sets, runs_for(least, recall), limit, depth))
    lists = buckets.groupBy("uid").agg(F.sort_array(F.collect_list("key")).alias("buckets"))
    known = written(lists.join(sets, "uid"))
    # A bucket beyond the limit is compared block by block, one task row for each pair of blocks.
    blocks = F.ceil(F.col("n") / (limit // 2)).cast("int")
    big = buckets.filter(F.col("n") > limit).withColumn("blk", F.pmod(F.xxhash64("uid", "key"), blocks).cast("int"))
    big = big.withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    big = big.select(
        F.xxhash64("key", F.least("blk", "other"), F.greatest("blk", "other")).alias("grp"), "key",
        (F.col("blk") != F.col("other")).alias("crossed"), "blk", "uid",
    )
    small = buckets.filter(F.col("n") <= limit).select(
        F.col("key").alias("grp"), "key", F.lit(False).alias("crossed"), F.lit(0).alias("blk"), "uid"
    )
    n = slice_count(spark)
    members = small.unionByName(big).join(known, "uid").repartition(n, "grp").sortWithinPartitions("grp")
    meeting = written(_meeting(members, near))

    wanted = meeting.select("uid").distinct().join(classes, "uid").select("uid", "fp", F.col("copy_of").alias("doc_id"))
    items = written(_shingle_sets(texts.join(wanted, "doc_id"), size).dropDuplicates(["uid"]))
    judged = meeting.join(known, "uid").join(items, "uid").repartition(n, "grp").sortWithinPartitions("grp")
    judged = written(_judge(judged, near, least))

    links = judged.groupBy("uid").agg(F.sum("links").alias("n_links"))
    group = components(judged.select(F.col("uid").alias("u"), F.col("root").alias("v")))
    linked = links.join(group.withColumnRenamed("node", "uid"), "uid").join(classes.select("uid", "copy_of"), "uid")
    linked = written(linked.select("uid", "n_links", "root", "copy_of"))
    name = written(linked.groupBy("root").agg(F.min("copy_of").alias("class_id"), F.count(F.lit(1)).alias("n")))
    linked = join_counted(linked.drop("copy_of"), name, "root", "n").select("uid", "n_links", "class_id")
    full = written(classes.join(linked, "uid", "left").select("fp", "copy_of", "n", "n_links", "class_id"))

    found = join_counted(whole_sets.select("doc_id", "text_hash", "fp"), full, "fp", "n").select(
        "doc_id", "text_hash", F.coalesce("class_id", "copy_of").alias("class_id"), "copy_of", F.col("n").alias("n_copies"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
    )
    alone = every.filter("fp is null or doc_id is null").select(
        "doc_id", "text_hash", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"),
        F.lit(1).cast("long").alias("n_copies"), F.lit(0).cast("long").alias("n_links"),
    )
    return found.unionByName(alone)


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one document of each group, the one with the smallest id; rows without
    an id stay, and so do other texts under the id of a copy."""
    key, own = free(docs, "near_id"), free(docs, "near_hash")
    groups = similar(docs, id_col=id_col, text_col=text_col, **how).filter("doc_id <> class_id")
    gone = groups.select(F.col("doc_id").alias(key), F.col("text_hash").alias(own)).distinct()
    rows = docs.withColumn(key, F.col(id_col).cast("long")).withColumn(
        own, F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    )
    return rows.join(gone, [key, own], "left_anti").select(*docs.columns)
