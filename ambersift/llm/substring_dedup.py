"""Repeated passages: every window of ``size`` words that an earlier document also has.

The Rabin-Karp hash of every window is counted by Spark, and the windows that also
start in a document with a smaller id merge into maximal intervals that are removed.

Most windows occur once, and shuffling all of them would cost several times the
input. So windows are counted only where a repeat is possible, which is exact: of the
k-gram hashes inside a window the smallest is its anchor; equal windows have equal
anchors. First the anchors (one for some twenty windows) are counted; then a window is
counted if its anchor occurs in two documents. Copies of a whole document are settled
by the hash of its words and take no part.

Windows are compared by 64-bit hashes; among 10**9 candidate windows the chance that
any two different ones are taken for equal is below 3 %.

* Null text has no words; a document of fewer than ``size`` words loses none.
* Rows with the same id are one document to the comparison: neither removes the other.
* A row without an id is left as it is and removes nothing.
* An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written
from .tables import join_counted
from .words import Words, rolling, whole, words_of


def _sliding_min(a: np.ndarray, n: int) -> np.ndarray:
    """Smallest of every ``n`` consecutive values."""
    width = 1
    while 2 * width <= n:
        a = np.minimum(a[:-width], a[width:])
        width *= 2
    return np.minimum(a[: len(a) - (n - width)], a[n - width :]) if n > width else a


def windows(w: Words, size: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, anchor and first word of every window that lies in one row."""
    h = w.hash
    ok = whole(w.at, size, len(h))
    if not ok.any():
        none = np.zeros(0, np.uint64)
        return none, none, np.zeros(0, np.int64)
    anchors = _sliding_min(rolling(h, gram), size - gram + 1)
    return rolling(h, size)[ok], anchors[ok], np.flatnonzero(ok)


def joined(w: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Kept words of each row with one space between, and where each row starts."""
    edge = np.zeros(len(w.data) + 1, np.int8)
    edge[w.start[keep]] += 1
    np.add.at(edge, w.end[keep], -1)
    mask = np.cumsum(edge[:-1], dtype=np.int8) > 0
    kept = np.flatnonzero(keep)
    row = w.row[kept]
    later = kept[1:][row[1:] == row[:-1]] if len(kept) else kept
    gap = w.start[later] - 1
    data = w.data.copy()
    data[gap] = 32
    mask[gap] = True
    before = np.concatenate([[0], np.cumsum(mask)])
    bounds = np.append(w.start, len(data))[w.at]
    # A row starts at its first word, or at the space before it if an earlier word was kept (never across rows).
    return data[mask], before[bounds]


def _signed(a: np.ndarray) -> np.ndarray:
    return a.view(np.int64)


def _scan(docs: DataFrame, size: int, gram: int) -> DataFrame:
    schema = pa.schema(
        [("doc_id", pa.int64()), ("variant", pa.int64()), ("n_words", pa.int64()), ("sha", pa.string()),
         ("anchors", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shas, lists = [], [], []
            for _, _, w in words_of(batch.column(2)):
                n = np.diff(w.at)
                text, at = joined(w, np.ones(len(w.start), bool))
                _, anchor, first = windows(w, size, gram)
                row = w.row[first]
                new = np.ones(len(anchor), bool)
                new[1:] = (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])
                anchor, cut = _signed(anchor[new]), np.searchsorted(row[new], np.arange(len(n) + 1))
                for k in range(len(n)):
                    shas.append(hashlib.sha256(text[at[k] : at[k + 1]].tobytes()).hexdigest())
                    lists.append(np.unique(anchor[cut[k] : cut[k + 1]]))
                counts.extend(n.tolist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(counts, pa.int64()), pa.array(shas, pa.string()),
                 pa.array(lists, pa.list_(pa.int64()))],
                schema=schema,
            )

    return docs.mapInArrow(run, "doc_id long, variant long, n_words long, sha string, anchors array<long>")


def _candidates(flagged: DataFrame, size: int, gram: int) -> DataFrame:
    """Windows whose anchor is one of the document's ``repeated``: hash, doc_id, and
    ``at``, the row's variant and the first word in one number."""
    schema = pa.schema([("h", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, variant, repeated = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(3)
            for a, b, w in words_of(batch.column(2)):
                h, anchor, first = windows(w, size, gram)
                row = w.row[first]
                part = repeated.slice(a, b - a)
                lists, values = part.value_lengths().to_numpy(), part.flatten().to_numpy()
                # (row, anchor) pairs are compared as one mixed number.
                salt = np.uint64(0x9E3779B97F4A7C15)
                want = np.sort(values.view(np.uint64) + np.repeat(np.arange(b - a), lists).astype(np.uint64) * salt)
                mine = anchor + row.astype(np.uint64) * salt
                spot = np.minimum(np.searchsorted(want, mine), len(want) - 1)
                hit = want[spot] == mine
                row, at = row[hit], (first - w.at[row])[hit]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_signed(h[hit])), pa.array(ids[a:b][row]), pa.array(variant[a:b][row] << 32 | at)], schema=schema
                )

    return flagged.select("doc_id", "variant", "text", "repeated").mapInArrow(run, "h long, doc_id long, at long")


def _remove(texts: DataFrame, size: int, with_text: bool) -> DataFrame:
    """``texts`` has doc_id, variant, text and ``starts`` of the windows to remove."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("variant", pa.int64()), ("n_removed", pa.int64()), ("cut_sha", pa.string()),
         ("kept_text", pa.string())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            starts = batch.column(3)
            removed, shas, texts_out = [], [], []
            for a, b, w in words_of(batch.column(2)):
                part = starts.slice(a, b - a)
                first = part.flatten().to_numpy() + np.repeat(w.at[:-1], part.value_lengths().to_numpy())
                edge = np.zeros(len(w.start) + 1, np.int64)
                np.add.at(edge, first, 1)
                np.add.at(edge, first + size, -1)
                gone = np.cumsum(edge[:-1]) > 0
                removed.extend(np.diff(np.concatenate([[0], np.cumsum(gone)])[w.at]).tolist())
                text, at = joined(w, ~gone)
                for k in range(b - a):
                    kept = text[at[k] : at[k + 1]].tobytes()
                    shas.append(hashlib.sha256(kept).hexdigest())
                    texts_out.append(kept.decode("utf-8", "replace") if with_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(shas, pa.string()),
                 pa.array(texts_out, pa.string())],
                schema=schema,
            )

    cols = texts.select("doc_id", "variant", "text", "starts")
    return cols.mapInArrow(run, "doc_id long, variant long, n_removed long, cut_sha string, kept_text string")


def substring_dedup(
    docs: DataFrame, size: int = 50, gram: int = 10, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, and with ``with_text``
    ``kept_text``, the words that stay (null where nothing is removed: the text is as it was)."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # With the id, the key of a row: an id may stand on rows with different texts.
    rows = rows.select("doc_id", F.pmod(F.xxhash64("text"), F.lit(1 << 30)).alias("variant"), "text")
    key = ["doc_id", "variant"]
    scan = written(_scan(rows, size, gram))

    # Copies of a whole document: the smallest id stays, the others lose every word.
    long_ones = scan.filter(f"n_words >= {size} and doc_id is not null").select(*key, "sha")
    groups = long_ones.groupBy("sha").agg(
        F.min("doc_id").alias("keep"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")
    )
    groups = written(groups.filter("keep < last").select("sha", "keep", "n"))
    copies = written(join_counted(long_ones, groups, "sha", "n").filter("doc_id > keep").select(*key).distinct())

    # Anchors that two documents have, and the documents that have them.
    alone = scan.filter("doc_id is not null").select(*key, "anchors").join(copies, key, "left_anti")
    anchors = alone.select(*key, F.explode("anchors").alias("anchor"))
    twice = anchors.groupBy("anchor").agg(
        F.min("doc_id").alias("a"), F.max("doc_id").alias("b"), F.count(F.lit(1)).alias("n")
    )
    twice = written(twice.filter("a < b").select("anchor", "n"))
    flagged = join_counted(anchors, twice, "anchor", "n").groupBy(*key).agg(F.collect_set("anchor").alias("repeated"))
    flagged = written(rows.join(flagged, key))

    # Windows counted; those that start in an earlier document go back to theirs.
    found = _candidates(flagged, size, gram)
    first = found.groupBy("h").agg(
        F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count(F.lit(1)).alias("n")
    )
    first = written(first.filter("first < last").select("h", "first", "n"))
    late = join_counted(found, first, "h", "n").filter("first < doc_id")
    late = late.select("doc_id", F.shiftright("at", 32).alias("variant"), F.col("at").bitwiseAND((1 << 32) - 1).cast("int").alias("at"))
    starts = late.groupBy(*key).agg(F.collect_set("at").alias("starts"))
    cut = _remove(flagged.drop("repeated").dropDuplicates(key).join(starts, key), size, with_text)

    out = scan.drop("anchors").join(copies.withColumn("copy", F.lit(True)), key, "left").join(cut, key, "left")
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(
        "doc_id", "n_words",
        F.when(F.col("copy"), F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(F.col("copy"), F.lit(empty)).otherwise(F.coalesce("cut_sha", "sha")).alias("kept_sha256"),
        *([F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept_text")).alias("kept_text")] if with_text else []),
    )
