"""Suppression directives in source texts, as an index per file.

A directive is a mark (``<tool>-ignore`` or ``<tool>:ignore``) in a line. In the first ten
lines, the mark with ``-file`` hides every hit of the file; else a line with a mark hides
hits on it and on the next line whose rule it names, or all if it says so. The index holds
the file flag, the number of lines and the marked lines, so that it is built once per
file and asked once per hit, also for each branch of a logical rule.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_any, lines_of

#: Says of (line, rule id) whether a hit there is hidden.
Hidden = Callable[[Column, Column], Column]
HEAD_LINES = 10


def has_directive(text: Column, directive: str) -> Column:
    return contains_any(text, [f"{directive}-ignore", f"{directive}:ignore"])


def directive_index(content: Column, directive: str) -> Column:
    """Null for a text without any mark, else (whole, lines, at: [(line, text)])."""
    lines = lines_of(content)
    head = F.slice(lines, 1, HEAD_LINES)
    whole = F.exists(head, lambda s: contains_any(s, [f"{directive}-ignore-file", f"{directive}:ignore-file"]))
    spots = F.transform(lines, lambda s, i: F.struct((i + 1).alias("line"), s.alias("text")))
    at = F.filter(spots, lambda s: has_directive(s["text"], directive))
    index = F.struct(whole.alias("whole"), F.size(lines).alias("lines"), at.alias("at"))
    return F.when(has_directive(content, directive), index)


def hidden_by(index: Column) -> Hidden:
    """An empty rule id, as the branches of a logical rule have, is named by every directive."""

    def hidden(line: Column, rule_id: Column) -> Column:
        named = F.exists(
            index["at"],
            lambda m: m["line"].isin(line, line - 1) & (F.contains(m["text"], F.lit("all")) | F.contains(m["text"], rule_id)),
        )
        return F.coalesce(index["whole"] | (line.between(1, index["lines"]) & named), F.lit(False))

    return hidden


def never(line: Column, rule_id: Column) -> Column:
    return F.lit(False)


def apply_inline_suppressions(hits: DataFrame, files: DataFrame, directive: str = "scan", exempt: tuple[str, ...] = ()) -> DataFrame:
    """Drop hidden hits (project, path, rule_id, line). What joins them is the index of the
    files that hold a mark, not their text. ``exempt`` rules (conditions on a whole file) are
    never hidden."""
    marked = files.filter(has_directive(F.col("content"), directive)).select(
        F.col("project").alias("_p"), F.col("path").alias("_f"), directive_index(F.col("content"), directive).alias("_marks")
    )
    joined = hits.join(marked, (F.col("project") == F.col("_p")) & (F.col("path") == F.col("_f")), "left")
    hidden = hidden_by(F.col("_marks"))(F.col("line"), F.col("rule_id"))
    if exempt:
        hidden = hidden & ~F.col("rule_id").isin(*exempt)
    return joined.filter(~hidden).drop("_p", "_f", "_marks")
