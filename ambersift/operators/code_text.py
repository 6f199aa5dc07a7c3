"""Code without comments and string contents, and the complement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# One token per alternative: plain text, triple-quoted block, C block, line
# comment with its line end, quoted string, a lone slash. Possessive loops keep
# the matcher flat on long strings.
TOKEN = (
    r"""[^"'`/#]++"""
    r'|"""[\s\S]*?(?:"""|\z)'
    r"|'''[\s\S]*?(?:'''|\z)"
    r"|/\*[\s\S]*?(?:\*/|\z)"
    r"|(?://|#)[^\n\r]*+[\n\r]?"
    r'|"(?:[^"\\]|\\[\s\S])*+(?:"|\\?\z)'
    r"|'(?:[^'\\]|\\[\s\S])*+(?:'|\\?\z)"
    r"|`(?:[^`\\]|\\[\s\S])*+(?:`|\\?\z)"
    r"|/"
)


def _is_plain(t: Column) -> Column:
    return ~F.left(t, F.lit(1)).isin('"', "'", "`", "/", "#")


def _is_block(t: Column) -> Column:
    return F.startswith(t, F.lit('"""')) | F.startswith(t, F.lit("'''")) | F.startswith(t, F.lit("/*"))


def _is_line_comment(t: Column) -> Column:
    return F.startswith(t, F.lit("//")) | F.startswith(t, F.lit("#"))


def _is_string(t: Column) -> Column:
    return F.left(t, F.lit(1)).isin('"', "'", "`")


def _code_of(t: Column, compat: bool) -> Column:
    newlines = F.regexp_replace(t, r"[^\n]", "")
    ends = F.regexp_replace(t, r"[^\n\r]", "")
    quote = F.left(t, F.lit(1))
    bare = F.regexp_replace(t, r"\\[\s\S]", "")
    closed = (F.length(bare) > 1) & (F.right(bare, F.lit(1)) == quote)
    inner = F.regexp_replace(bare if compat else t, r"[^\n]", "")
    return (
        F.when(_is_plain(t), t)
        .when(_is_block(t), F.lit("") if compat else newlines)
        .when(_is_line_comment(t), ends)
        .when(_is_string(t), F.concat(quote, inner, F.when(closed, quote).otherwise(F.lit(""))))
        .otherwise(t)
    )


def _docs_of(t: Column) -> Column:
    readable = ~_is_plain(t) & (_is_string(t) | _is_line_comment(t) | _is_block(t))
    return F.when(readable, t).otherwise(F.regexp_replace(t, r"[^\n]", " "))


def split_code_docs(files: DataFrame, compat: bool = False) -> DataFrame:
    """Add ``code`` and ``docs``. Line numbers are kept; with ``compat`` block
    comments and escaped line ends lose their newlines."""
    tokens = F.regexp_extract_all(F.col("content"), F.lit(TOKEN), F.lit(0))
    cut = files.withColumn("_tokens", tokens)
    return cut.withColumns(
        {
            "code": F.array_join(F.transform("_tokens", lambda t: _code_of(t, compat)), ""),
            "docs": F.array_join(F.transform("_tokens", _docs_of), ""),
        }
    ).drop("_tokens")
