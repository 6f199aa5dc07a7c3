"""Spelling variants: words one edit apart, found by PartEnum signatures of their letters.

A word's letters are a multiset, read as a binary vector with one dimension for each
(letter, how often it occurred so far). One inserted or deleted letter changes one
dimension, one replaced letter two, so near words lie within Hamming distance two.
Dimensions are dealt to ``parts`` parts by hash; two differences touch two parts at
most, so near words agree on all dimensions of some choice of ``parts - 2`` parts. A
word's signatures are the hashes of its dimensions in every such choice; words with an
equal signature are joined and verified by their edit distance.

A signature that more than ``limit`` words share is split, not cut: of two words one
edit apart, with ``m`` letters in the shorter one, either the first ``m // 2`` letters
are equal or the last ``m - m // 2`` are, so within it only words that agree on one of
the two are compared. Links are counted by Spark before and after shuffles; no
signature is ever held by one task as a whole.

* Null text has no words; a null id counts as an empty one. Texts and words of any
  length are read whole. Rows that repeat an id or a text count each.
* Ties: the form of a word is its near word of largest count, then first in the order
  of code points.
* An empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .tables import join_counted
from .words import mix

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[a-zÀ-ÿ]+"


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", noise: int = 97, shortest: int = 5, least: int = 3
) -> DataFrame:
    """(word, n): letter runs of the lower-cased texts, of at least ``shortest`` letters and
    ``least`` occurrences. Where ``noise`` divides the CRC-32 ``h`` of ``<id>:<run>``, the
    run loses its letter ``h % length`` first; 0 leaves all runs as they are."""
    text = F.translate(F.coalesce(F.col(text_col), F.lit("")), UPPER, LOWER)
    key = F.coalesce(F.col(id_col).cast("string"), F.lit(""))
    runs = docs.select(key.alias("key"), F.explode(F.regexp_extract_all(text, F.lit(RUN), F.lit(0))).alias("word"))
    runs = runs.filter(F.length("word") >= shortest)
    if noise:
        h = F.crc32(F.concat("key", F.lit(":"), "word").cast("binary"))
        spot = (F.col("h") % F.length("word")).cast("int")
        cut = F.concat(F.col("word").substr(F.lit(1), spot), F.col("word").substr(spot + 2, F.length("word")))
        runs = runs.withColumn("h", h).select(F.when(F.col("h") % noise == 0, cut).otherwise(F.col("word")).alias("word"))
        runs = runs.filter(F.length("word") >= shortest)
    return runs.groupBy("word").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)


def letter_signatures(words: list[str], parts: int, edits: int = 2) -> np.ndarray:
    """One row per word, one 64-bit signature per choice of ``parts - edits`` parts."""
    n = np.array([len(w) for w in words], np.int64)
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    row = np.repeat(np.arange(len(words)), n)
    order = np.lexsort((letters, row))
    letters, row = letters[order], row[order]
    fresh = np.ones(len(letters), bool)
    fresh[1:] = (letters[1:] != letters[:-1]) | (row[1:] != row[:-1])
    spot = np.arange(len(letters))
    seen = spot - np.maximum.accumulate(np.where(fresh, spot, 0))
    dim = mix((letters << 32 | seen).astype(np.uint64) + np.uint64(1))
    part = mix(dim.copy()) % np.uint64(parts)
    # The hash of a part is the sum of its dimensions' hashes, whatever their order.
    sums = np.zeros((parts, len(words)), np.uint64)
    for p in range(parts):
        np.add.at(sums[p], row[part == p], dim[part == p])
    whole = sums.sum(axis=0, dtype=np.uint64)
    out = np.empty((len(words), len(list(combinations(range(parts), edits)))), np.uint64)
    for k, left_out in enumerate(combinations(range(parts), edits)):
        out[:, k] = mix(mix(whole - sums[list(left_out)].sum(axis=0, dtype=np.uint64)) + np.uint64(k + 1))
    return out


def with_signatures(table: DataFrame, parts: int) -> DataFrame:
    """(word, sig): a row for each signature of each word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch["word"].to_pylist()
            if not words:
                continue
            sigs = letter_signatures(words, parts)
            again = np.repeat(np.arange(len(words)), sigs.shape[1])
            yield pa.RecordBatch.from_arrays(
                [batch["word"].take(pa.array(again)), pa.array(sigs.reshape(-1).view(np.int64))], ["word", "sig"]
            )

    return table.select("word").mapInArrow(run, "word string, sig long")


def _halves() -> Column:
    """The half words on which a word agrees with a near one, for either length of the shorter."""
    word, size = F.col("word"), F.length("word")
    keys = []
    for m in (size, size - 1):
        half = F.floor(m / 2).cast("int")
        keys.append(F.xxhash64(F.lit("head"), m, word.substr(F.lit(1), half)))
        keys.append(F.xxhash64(F.lit("tail"), m, F.right(word, m - half)))
    return F.array(*keys)


def near_words(table: DataFrame, parts: int = 7, limit: int = 64) -> DataFrame:
    """(a, b), ``a`` before ``b``: all pairs of words of ``table`` that differ by exactly one
    inserted, deleted or replaced code point, each once."""
    sigs = written(with_signatures(table, parts))
    # How many words share a signature; most stand alone and need no further step.
    shared = written(sigs.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).filter("c > 1"))
    rows = written(join_counted(sigs, shared, "sig", "c"))
    small = rows.filter(F.col("c") <= limit).select("word", "sig", F.lit(0).cast("long").alias("half"))
    large = rows.filter(F.col("c") > limit).select("word", "sig", F.explode(_halves()).alias("half"))
    rows = small.unionByName(large)
    other = rows.select(F.col("word").alias("b"), "sig", "half")
    near = (F.col("a") < F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1)
    pairs = rows.withColumnRenamed("word", "a").join(other, ["sig", "half"]).filter(near)
    return pairs.select("a", "b").distinct()


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): where the chain of ``forms`` (word, form) ends, for every word of it.

    Chains have no circles, since every form is more frequent than its word. Each round
    replaces every pointer by that of its target, so a chain halves; a round is written."""
    known = written(forms.select("word", F.col("form").alias("root")))
    while True:
        on = known.select(F.col("word").alias("root"), F.col("root").alias("next"))
        rows = written(known.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        known = rows.select("word", "root")
        if not rows.filter("moved").limit(1).count():
            return known


def spelling_variants(docs: DataFrame, parts: int = 7, limit: int = 64, ratio: int = 2, **how) -> DataFrame:
    """One row per word: ``word``, ``n``, ``n_near``, ``form`` and ``form_n`` (its most frequent
    near word and that one's count, if at least ``ratio`` times its own) and ``root``."""
    table = written(word_counts(docs, **how))
    pairs = written(near_words(table, parts, limit))
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"))
    both = both.unionByName(both.select(F.col("near").alias("word"), F.col("word").alias("near")))
    other = table.select(F.col("word").alias("near"), F.col("n").alias("m"))
    best = both.join(other, "near").groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "near")).alias("best")
    )
    rows = table.join(best, "word", "left")
    holds = -F.col("best.m") >= F.col("n") * ratio
    rows = written(rows.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(holds, F.col("best.near")).alias("form"), F.when(holds, -F.col("best.m")).alias("form_n"),
    ))
    ends = roots(rows.filter("form IS NOT NULL"))
    out = rows.join(ends, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: SQL that gives the rows of ``spelling_variants``: CRC-32 by its table, near words by masked letters.
SPELLING_SQL = rf"""
    WITH crc AS (
      SELECT list(c ORDER BY i) AS t
      FROM (SELECT i, list_reduce(list_prepend(i, range(8)),
                   lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
            FROM range(256) r(i))),
    runs AS (
      SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[a-z\x{{C0}}-\x{{FF}}]+')) AS run
      FROM documents),
    g AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
    h AS (
      SELECT run, n, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(
               string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run, ''),
               lambda x: CASE WHEN ord(x) < 128 THEN [ord(x)::BIGINT] ELSE [192::BIGINT + ord(x) // 64, 128::BIGINT + ord(x) % 64] END))),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
      FROM g, crc),
    cut AS (
      SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n
      FROM h),
    v AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
    spots AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS k FROM v),
    masks AS (SELECT word, n, length(word) AS size, substr(word, 1, k - 1) || '?' || substr(word, k + 1) AS mask FROM spots),
    shorter AS (SELECT DISTINCT word, n, substr(word, 1, k - 1) || substr(word, k + 1) AS less FROM spots),
    near AS (
      SELECT a.word, b.word AS near, b.n AS m FROM masks a JOIN masks b ON a.mask = b.mask AND a.word <> b.word
      UNION ALL SELECT s.word, v.word, v.n FROM shorter s JOIN v ON s.less = v.word
      UNION ALL SELECT v.word, s.word, s.n FROM shorter s JOIN v ON s.less = v.word),
    ranked AS (
      SELECT word, near, m, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY m DESC, near) AS place
      FROM near),
    forms AS (
      SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 2 * v.n THEN near END AS form, CASE WHEN m >= 2 * v.n THEN m END AS form_n
      FROM v LEFT JOIN ranked r ON r.word = v.word AND place = 1),
    chain AS (
      WITH RECURSIVE c AS (
        SELECT word, form AS at FROM forms WHERE form IS NOT NULL
        UNION ALL SELECT c.word, f.form FROM c JOIN forms f ON f.word = c.at WHERE f.form IS NOT NULL)
      SELECT c.word, c.at FROM c JOIN forms f ON f.word = c.at WHERE f.form IS NULL)
    SELECT forms.word, form, coalesce(chain.at, forms.word) AS root, n, n_near, form_n
    FROM forms LEFT JOIN chain ON chain.word = forms.word
"""
