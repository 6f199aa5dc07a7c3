"""Mixing sources to target weights along a curriculum, in Spark functions only.

Every source has a weight schedule over training time 0 to 1: a chain of points
(time, weight), linear in between. Its integral is the source's weight in the whole
mix. Targets share the budget (all words) by weight and stop at ``repeats`` times a
source's words; what is left over goes to the other sources by weight until none is
above. A source's documents stand in a fixed random order, one round after the other;
the copy that starts at word ``c`` of a source's demand is read at the time by which
the integral of the schedule reaches that share of it. Sorting copies by that time
(a range sort) gives the training order: at any time each source is read at the rate
its schedule names.

Only narrow rows (id, source, size, ticket) are shuffled, and they are laid out in
ranges of (source, ticket): a source with a third of all rows is spread over many
slices, and running sums are carried from slice to slice.

* Null text counts as empty text; a document without words has size 0, nothing is
  taken of it, and it has no position. A text of any length is one row; the copy that
  crosses its source's target is cut there, so a source's words differ from its target
  by less than one word.
* A null source is a source of its own and comes last; an empty name comes first.
* Rows that repeat an id are documents of their own; ties of the ticket go by id, then
  size, so that reruns agree. A null id is allowed.
* An empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.ordering import rank_within, running_within
from ..session import written

Knots = Sequence[tuple[float, float]]

#: Weights 1, 2 and 3 in the whole: the first fades out, the second is steady, the
#: third comes late. Sources take them in turn.
SCHEDULE: tuple[Knots, ...] = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 2.0), (1.0, 2.0)),
    ((0.0, 2.0), (0.5, 2.5), (1.0, 5.0)),
)


def integral(knots: Knots) -> list[float]:
    """The schedule's integral from time 0 to each of its points."""
    out = [0.0]
    for (t, w), (u, v) in zip(knots, knots[1:]):
        out.append(out[-1] + (u - t) * (w + v) / 2)
    return out


def check(schedule: Sequence[Knots]) -> None:
    for knots in schedule:
        times = [t for t, _ in knots]
        if times[0] != 0 or times[-1] != 1 or sorted(set(times)) != times:
            raise ValueError(f"times must rise from 0 to 1: {knots}")
        if min(w for _, w in knots) < 0 or integral(knots)[-1] <= 0:
            raise ValueError(f"weights must not be negative, their integral not 0: {knots}")


def when_reached(knots: Knots, share: Column) -> Column:
    """Time at which the integral of the schedule is ``share`` of the whole."""
    area = integral(knots)
    x, out = share * area[-1], None
    for k in reversed(range(len(knots) - 1)):
        (t, w), (u, v) = knots[k], knots[k + 1]
        d = x - area[k]
        # The root of w*s + slope/2*s*s = d, in the form that also holds for slope 0.
        root = F.sqrt(F.greatest(F.lit(w * w) + d * (2 * (v - w) / (u - t)), F.lit(0.0)))
        at = F.when(d <= 0, F.lit(t)).otherwise(F.lit(t) + d * 2 / (F.lit(w) + root))
        out = at if out is None else F.when(x < area[k + 1], at).otherwise(out)
    return F.least(out, F.lit(1.0))


def by_class(place: Column, values: Sequence[Column]) -> Column:
    """The value whose turn it is at ``place`` (from 1)."""
    out = values[0]
    for k in range(1, len(values)):
        out = F.when((place - 1) % len(values) == k, values[k]).otherwise(out)
    return out


def targets(sources: DataFrame, schedule: Sequence[Knots], repeats: int) -> DataFrame:
    """``sources`` (source, source_size) plus ``place``, ``weight`` and ``target``.

    A source stops at its cap if the water level at which it does is reached: sources by
    cap over weight, all earlier ones at their caps, all later ones at that level.
    """
    rows = rank_within(sources, [], [F.col("source").asc_nulls_last()], "place")
    weights = [F.lit(integral(knots)[-1]) for knots in schedule]
    rows = rows.withColumn("weight", by_class(F.col("place"), weights))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(repeats))
    rows = rows.withColumn("level", F.col("cap") / F.col("weight"))
    order = [F.col("level"), F.col("place")]
    rows = running_within(rows, [], order, F.col("cap"), "caps", "_c").drop("_c")
    rows = running_within(rows, [], order, F.col("weight"), "upto", "_c").drop("_c")
    rows = written(rows)
    budget, whole = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, whole = int(budget or 0), float(whole or 0)
    full = F.col("caps") + F.col("level") * (F.lit(whole) - F.col("upto")) <= F.lit(budget)
    rows = rows.withColumn("full", full)
    spent, rest = rows.agg(
        F.sum(F.when(F.col("full"), F.col("cap"))), F.sum(F.when(~F.col("full"), F.col("weight")))
    ).first()
    left = float(budget - int(spent or 0))
    share = F.col("weight") * F.lit(left) / F.lit(float(rest or 1))
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share)
    return rows.withColumn("target", target).select("source", "source_size", "place", "weight", "target")


def sized(docs: DataFrame, id_col: str, text_col: str, by: str, seed: int) -> DataFrame:
    """(doc_id, source, size in words, ticket) of every row."""
    key, source = F.col(id_col).cast("long"), F.col(by).cast("string")
    words = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"))
    ticket = F.md5(F.concat_ws("|", F.lit(str(seed)), key.cast("string"), source).cast("binary"))
    return docs.select(key.alias("doc_id"), source.alias("source"), words.cast("long").alias("size"), ticket.alias("ticket"))


def curriculum(
    docs: DataFrame, schedule: Sequence[Knots] = SCHEDULE, repeats: int = 3, seed: int = 11,
    id_col: str = "doc_id", text_col: str = "text", by: str = "source",
) -> DataFrame:
    """One row per document, by the time at which it is first read (documents that the
    mix leaves out come last): ``doc_id``, ``source``, ``size``, ``source_size``, ``target``,
    ``taken``, ``position`` (that time) and ``copies``, an array of (position, words)."""
    check(schedule)
    rows = written(sized(docs, id_col, text_col, by, seed))
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), schedule, repeats)
    order = [F.col("ticket"), F.col("doc_id"), F.col("size")]
    rows = running_within(rows, ["source"], order, F.col("size"), "upto", "_c").drop("_c")
    right = sources.withColumnRenamed("source", "of")
    rows = rows.join(right, rows["source"].eqNullSafe(right["of"])).drop("of")
    demand = F.round("target").cast("long")

    def copy(k: int) -> Column:
        start = F.col("source_size") * k + F.col("upto") - F.col("size")
        words = F.greatest(F.least(demand - start, F.col("size")), F.lit(0).cast("long"))
        share = start / F.nullif(demand, F.lit(0).cast("long"))
        at = by_class(F.col("place"), [when_reached(knots, share) for knots in schedule])
        return F.struct(at.alias("position"), words.alias("words"))

    rows = rows.withColumn("copies", F.filter(F.array(*[copy(k) for k in range(repeats)]), lambda c: c["words"] > 0))
    taken = F.aggregate("copies", F.lit(0).cast("long"), lambda a, c: a + c["words"])
    rows = rows.select(
        "doc_id", "source", "size", "source_size", "target", taken.alias("taken"),
        F.get("copies", F.lit(0))["position"].alias("position"), "copies", "ticket",
    )
    return rows.orderBy(F.col("position").asc_nulls_last(), "ticket", "doc_id").drop("ticket")


def training_order(plan: DataFrame) -> DataFrame:
    """One row per copy that ``curriculum`` takes, in the order of training: ``doc_id``,
    ``source``, ``copy`` (from 0), ``words`` (fewer than the document's if it is cut) and
    ``position``."""
    rows = plan.select("doc_id", "source", F.posexplode("copies").alias("copy", "c"))
    rows = rows.select("doc_id", "source", "copy", "c.words", "c.position")
    return rows.orderBy("position", "source", "doc_id", "copy")


#: SQL that gives the rows of ``curriculum`` with the default schedule (positions of first copies).
MIXTURE_SQL = r"""
    WITH d AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
             md5(concat_ws('|', '11', CAST(doc_id AS VARCHAR), source)) AS ticket
      FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    r AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM s),
    w AS (SELECT *, CAST(turn + 1 AS DOUBLE) AS weight, 3 * source_size AS cap, 3 * source_size / CAST(turn + 1 AS DOUBLE) AS level FROM r),
    c AS (
      SELECT *, sum(cap) OVER o AS caps, sum(weight) OVER o AS upto, sum(source_size) OVER () AS budget, sum(weight) OVER () AS whole
      FROM w WINDOW o AS (ORDER BY level, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
    f AS (SELECT *, caps + level * (whole - upto) <= budget AS is_full FROM c),
    t AS (
      SELECT source, source_size, turn, CASE WHEN is_full THEN CAST(cap AS DOUBLE) ELSE
             weight * CAST(budget - coalesce(sum(cap) FILTER (is_full) OVER (), 0) AS DOUBLE)
             / sum(weight) FILTER (NOT is_full) OVER () END AS target
      FROM f),
    p AS (
      SELECT doc_id, size, source_size, turn, target, CAST(round(target) AS BIGINT) AS demand, CAST(sum(size) OVER (
               PARTITION BY d.source ORDER BY ticket, doc_id, size ROWS UNBOUNDED PRECEDING) AS BIGINT) - size AS start
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    x AS (
      SELECT *, greatest(least(demand - start, size), 0) + greatest(least(demand - start - source_size, size), 0)
             + greatest(least(demand - start - 2 * source_size, size), 0) AS taken,
             start / CAST(nullif(demand, 0) AS DOUBLE) * (turn + 1) AS a
      FROM p)
    SELECT doc_id, size, source_size, target, taken, CASE WHEN size > 0 AND start < demand THEN CASE
             WHEN turn = 0 THEN a * 2 / (1.5 + sqrt(greatest(2.25 + a * -2.0, 0)))
             WHEN turn = 1 THEN a * 2 / (2.0 + sqrt(4.0))
             WHEN a < 1.125 THEN a * 2 / (2.0 + sqrt(4.0 + a * 2.0))
             ELSE 0.5 + (a - 1.125) * 2 / (2.5 + sqrt(6.25 + (a - 1.125) * 10.0)) END END AS position
    FROM x
"""
