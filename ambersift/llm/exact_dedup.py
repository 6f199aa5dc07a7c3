"""Exact copies by a tree merge of sorted digest runs, in Spark functions only.

Documents are dealt by id to ``fan ** rounds`` runs. A run holds one row for each
different text: digest, check values, the row that would stay, and a count. In
round ``r`` a run hands its rows to the run whose ``r``-th digit (base ``fan``) is
that of the digest, so each run merges sorted rows of ``fan`` others, and after
``rounds`` exchanges every digest is in one run. A text that fills a third of the
table therefore never sends more than ``fan`` rows of a run to one merge. The way
back is the same: the row that stays goes to the runs that hold the digest, and
from a run to its documents.

Rows are merged only if SHA-256, an independent 64-bit hash and the byte length all
agree, at every level.

* Null text is empty text; empty texts are copies of each other.
* Ties in length go to the smallest id; a null id loses to any other; of repeated
  rows with the same id, one stays.
* An empty table gives an empty result; other columns are ignored, whatever their
  names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import slice_count, written
from .tables import free

BLANKS = " \t\n\x0b\x0c\r"
_KEY = ("digest", "check", "size")


def without_blanks(text: Column) -> Column:
    """``text`` without blanks, tabs and line ends; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in BLANKS:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, digest and check values of the text without blanks,
    and ``chars``, the code points of the text as it is."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.select("id", F.length("t").alias("chars"), without_blanks(F.col("t")).alias("t"))
    return rows.select(
        "id", "chars", F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("digest"),
        F.xxhash64("t").alias("check"), F.octet_length("t").alias("size"),
    )


def _digit(of: Column, fan: int, r: int) -> Column:
    return F.floor(of / F.lit(fan**r)).cast("long") % fan


def keep_first(table: DataFrame, fan: int, rounds: int) -> DataFrame:
    """``table`` (rows of ``digests`` with a stable row number ``at``) plus ``keep_id``,
    ``group_size`` and ``kept``."""
    runs = fan**rounds
    dealt = table.withColumn("run", F.pmod(F.xxhash64("id"), F.lit(runs)))
    # ~x falls as x grows and cannot overflow: the largest entry has the most
    # characters, then the smallest id, then the smallest row number.
    best = F.struct("chars", F.bitwise_not("id").alias("nid"), F.bitwise_not("at").alias("nat"))
    local = dealt.groupBy("run", *_KEY).agg(F.max(best).alias("best"), F.count(F.lit(1)).alias("n"))
    state = local
    home = F.pmod(F.col("check"), F.lit(runs))
    for r in range(rounds):
        moved = F.col("run") + (_digit(home, fan, r) - _digit(F.col("run"), fan, r)) * fan**r
        state = state.withColumn("run", moved).groupBy("run", *_KEY).agg(F.max("best").alias("best"), F.sum("n").alias("n"))
    # Texts that occur once need no way back.
    groups = state.filter("n > 1").select(*_KEY, "best", "n")
    held = local.select("run", *_KEY).join(groups, list(_KEY))
    out = dealt.join(held, ["run", *_KEY], "left")
    alone = F.col("n").isNull()
    return out.select(
        "id", "at", *_KEY,
        F.when(alone, F.col("id")).otherwise(F.bitwise_not("best.nid")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.bitwise_not("best.nat") == F.col("at"))).alias("kept"),
    )


def tree_shape(runs_wanted: int, fan: int) -> int:
    """Rounds that give at least ``runs_wanted`` runs."""
    rounds = 1
    while fan**rounds < runs_wanted:
        rounds += 1
    return rounds


def exact_dedup(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fan: int = 8, rounds: int | None = None
) -> DataFrame:
    """One row per document: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``
    (plus ``check`` and ``size``). Writes the digests once to the shared folder."""
    spark = docs.sparkSession
    table = written(digests(docs, id_col, text_col).withColumn("at", F.monotonically_increasing_id()))
    out = keep_first(table, fan, rounds or tree_shape(slice_count(spark), fan))
    return out.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"),
        "check", "size",
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the rows that are copies of another (all columns as they were)."""
    key, own, want = (free(docs, n) for n in ("id_key", "own_sha", "kept_sha"))
    stays = exact_dedup(docs, id_col, text_col, **how).filter("kept").select(
        F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias(want)
    )
    rows = docs.withColumn(key, F.col(id_col).cast("long")).withColumn(
        own, F.sha2(without_blanks(F.col(text_col)).cast("binary"), 256)
    )
    same = rows[key].eqNullSafe(stays["kept_id"]) & (rows[own] == stays[want])
    # Only rows that repeat the id and the text are left to merge; both lie in one partition already.
    return rows.join(stays, same, "left_semi").dropDuplicates([key, own]).select(*docs.columns)
