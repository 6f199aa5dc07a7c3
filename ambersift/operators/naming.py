"""Names that occur in texts: a filtered posting index, then one look per text.

Every name is met by one piece of it, the four-character piece that fewest names have (a
shorter name by itself). The chosen pieces become a bit table (``citations``); of a text's
pieces only those whose bit is set leave the scan, as narrow (piece, text id) rows, never
with the text. Postings meet the names of their piece, and each text that has candidates
is joined once with all of them and searched for whole names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from .citations import cited_only

GRAM = 4
#: A piece that a third of all texts hold is dealt to so many keys.
SALT = 16


def text_id(text: Column) -> Column:
    return F.sha2(text, 256)


def distinct_texts(texts: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by.., tid, text): every different text once, written; null and empty ones left out."""
    rows = texts.select(*by, "text").filter(F.col("text") != "").distinct()
    return written(rows.select(*by, text_id(F.col("text")).alias("tid"), "text"))


def _grams(text: Column, n: int) -> Column:
    """Distinct substrings of ``n`` characters."""
    starts = F.sequence(F.lit(1), F.length(text) - (n - 1))
    some = F.transform(starts, lambda i: F.substr(text, i, F.lit(n)))
    return F.when(F.length(text) >= n, F.array_distinct(some)).otherwise(F.array().cast("array<string>"))


def pieces_of_names(names: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by.., name, piece): the piece by which each name is met, written."""
    names = names.select(*by, "name").filter(F.col("name") != "").distinct()
    pieces = F.when(F.length("name") < GRAM, F.array("name")).otherwise(_grams(F.col("name"), GRAM))
    held = names.select(*by, "name", F.explode(pieces).alias("piece"))
    common = held.groupBy(*by, "piece").agg(F.count(F.lit(1)).alias("n"))
    rarest = F.min(F.struct("n", "piece")).alias("m")
    least = held.join(common.hint("merge"), [*by, "piece"]).groupBy(*by, "name").agg(rarest)
    return written(least.select(*by, "name", F.col("m.piece").alias("piece")))


def postings(texts: DataFrame, pieces: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by.., tid, piece): pieces of texts that some name chose, and hardly any other."""
    # Lengths that no name has need not be cut out of texts.
    sizes = sorted(r["n"] for r in pieces.select(F.length("piece").alias("n")).distinct().collect())
    every = F.concat(*[_grams(F.col("text"), n) for n in sizes or [GRAM]])
    spread = texts.select(*by, "tid", F.explode(every).alias("piece"))
    return cited_only(spread, pieces.select(*by, "piece").distinct(), [*by, "piece"])


def names_in(texts: DataFrame, names: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by.., tid, name): the names that occur in a text, each pair once. ``texts`` has each
    text once, as (by.., tid, text). Null and empty names occur nowhere."""
    by = list(by)
    pieces = pieces_of_names(names, by)
    found = postings(texts, pieces, by).withColumn("_salt", F.pmod(F.xxhash64("tid"), F.lit(SALT)))
    salted = pieces.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALT - 1).cast("long"))))
    # Names are merged, not sent to every task: they are as many as there are groups, and the
    # small files they were written to say little of their size, even less after salting.
    pairs = written(found.join(salted.hint("merge"), [*by, "piece", "_salt"]).select(*by, "tid", "name"))
    # A short name is its own piece, so that the posting is the answer.
    short = pairs.filter(F.length("name") <= GRAM)
    asked = pairs.filter(F.length("name") > GRAM).groupBy(*by, "tid").agg(F.collect_set("name").alias("_names"))
    met = cited_only(texts, asked, [*by, "tid"]).join(asked.hint("merge"), [*by, "tid"])
    held = F.filter("_names", lambda n: F.contains(F.col("text"), n))
    return met.select(*by, "tid", F.explode(held).alias("name")).unionByName(short)


def texts_naming(texts: DataFrame, names: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by.., text, name) of ``names_in``, with the text itself."""
    by = list(by)
    rows = distinct_texts(texts, by)
    return rows.join(names_in(rows, names, by), [*by, "tid"]).select(*by, "text", "name")
