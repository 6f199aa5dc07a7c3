"""Path predicates and normalisation as Column expressions."""

from __future__ import annotations

import posixpath
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import contains_any, once, trimmed

# Names of folders that hold test, mock, fixture or spec code.
TEST_DIRS = (
    "test", "tests", "testdata", "__tests__", "mock", "mocks", "__mocks__",
    "fixture", "fixtures", "__fixtures__", "spec", "specs", "__specs__",
)
# Dependency, build and version-control folders.
VENDORED_PARTS = ("/node_modules/", "/vendor/", "/.git/", "/dist/", "/build/", "/.next/")
# Extensions of files that are worth scanning.
SOURCE_EXTS = (
    ".go", ".py", ".js", ".ts", ".jsx", ".tsx", ".java", ".rb", ".rs", ".cs", ".php",
    ".yaml", ".yml", ".json", ".toml", ".html", ".vue", ".svelte", ".sql", ".sh", ".bash",
    ".dockerfile", ".tf", ".hcl",
)
SOURCE_NAMES = ("Dockerfile", "docker-compose.yaml", "docker-compose.yml")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dir_name(path: Column) -> Column:
    """Folder of a file, '.' for a file at the root."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*\z", "")).otherwise(F.lit("."))


def raw_extension(path: Column) -> Column:
    """From the last dot of the base name, '' without one; a single look at the path."""
    return F.regexp_extract(path, r"(\.[^./]*)\z", 1)


def extension(path: Column) -> Column:
    return F.lower(raw_extension(path))


def _folded(path: Column) -> Column:
    rooted = F.startswith(path, F.lit("/"))

    def step(acc: Column, part: Column) -> Column:
        up = part == ".."
        can_pop = (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != "..")
        return (
            F.when((part == "") | (part == "."), acc)
            .when(up & can_pop, F.slice(acc, F.lit(1), F.size(acc) - 1))
            .when(up & rooted, acc)
            .otherwise(F.concat(acc, F.array(part)))
        )

    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step)
    joined = F.concat(F.when(rooted, F.lit("/")).otherwise(F.lit("")), F.array_join(parts, "/"))
    return F.when(joined == "", F.lit(".")).otherwise(joined)


# What makes a path differ from its cleaned form: empty parts, '.' or '..'.
UNCLEAN = r"//|(?:^|/)\.{1,2}(?:/|\z)|/\z|^\z"
# The same, or white space and backslashes that normalising removes first.
UNUSUAL = rf"{UNCLEAN}|\\|^\s|\s\z"


def _cleaned(path: Column) -> Column:
    flat = F.regexp_replace(path, r"^(?:\./+)+|(?<=/)(?:\.?/)+", "")
    flat = F.regexp_replace(flat, r"(?<=[^/])/\.?\z|(?<=^/)\.\z", "")
    climbs = F.rlike(path, F.lit(r"(?:^|/)\.\.(?:/|\z)"))
    return F.when(climbs, F.element_at(F.transform(F.array(path), _folded), 1)).otherwise(
        F.coalesce(F.nullif(flat, F.lit("")), F.lit("."))
    )


def clean_path(path: Column) -> Column:
    """Resolve '//', '/./' and 'a/../'.

    One cheap test sends ordinary paths straight through; only those with '..' need
    the fold over their parts."""
    return F.when(F.rlike(path, F.lit(UNCLEAN)), _cleaned(path)).otherwise(path)


def normalize_path(path: Column) -> Column:
    """Comparable form: no scan prefix, forward slashes, cleaned, lower case."""
    p = F.regexp_replace(F.replace(trimmed(path), F.lit("\\"), F.lit("/")), r"^(?:/src/)?(?:\./)?/?", "")
    unusual = F.when(trimmed(path) == "", F.lit("")).otherwise(_cleaned(p))
    plain = F.regexp_replace(path, r"^(?:/src/|\./|/)", "")
    return F.lower(F.when(F.rlike(path, F.lit(UNUSUAL)), unusual).otherwise(plain))


def is_test_like(path: Column) -> Column:
    """Test, mock, fixture or spec code, by path structure only."""
    p = F.lower(clean_path(F.replace(path, F.lit("\\"), F.lit("/"))))
    dirs = "|".join(TEST_DIRS)
    shape = (
        rf"(?:^|/)(?:{dirs})(?:/|\z)"
        r"|(?:^|/)conftest\.py\z"
        r"|\.(?:test|spec|mock)\.[^/]*\z"
        r"|(?:^|/)(?:test|mock|spec)_[^/]*\z"
        r"|_(?:test|mock|spec)(?:\.[^./]*)?\z"
    )
    return F.rlike(p, F.lit(shape))


def is_vendored(path: Column) -> Column:
    return F.rlike(path, F.lit("|".join(re.escape(p) for p in VENDORED_PARTS)))


def ext_match(path: Column, exts: Sequence[str]) -> Column:
    """Extension or whole base name (Dockerfile) is in the list, any case."""
    return kind_match(extension(path), F.lower(base_name(path)), exts)


def kind_match(ext: Column, base: Column, exts: Sequence[str]) -> Column:
    """``ext_match`` on an extension and base name that are at hand, in lower case."""
    wanted = [e.lower() for e in exts]
    return ext.isin(wanted) | base.isin(wanted)


def exclude_paths(path: Column, fragments: Sequence[str]) -> Column:
    return contains_any(path, fragments)


def is_source_file(path: Column) -> Column:
    return raw_extension(path).isin(*SOURCE_EXTS) | base_name(path).isin(*SOURCE_NAMES)


def product_name(path: Column) -> Column:
    """Last path part after mount prefixes, or a fixed fallback."""
    p = F.when(F.length(path) > 1, F.regexp_replace(path, r"(?<=.)[/\\]+\z", "")).otherwise(path)
    for prefix in ("/host/", "/project/"):
        p = F.when(
            F.startswith(p, F.lit(prefix)) & (F.length(p) > len(prefix)), F.substring(p, len(prefix) + 1, 1 << 30)
        ).otherwise(p)
    name = F.regexp_extract(p, r"([^/\\]*)\z", 1)
    return F.when(name.isin("", ".", "project", "host"), F.lit("unnamed-project")).otherwise(name)


def path_suffixes(path: Column) -> Column:
    """All '/'-suffixes of a path, the path itself included."""
    parts = F.split(path, "/")
    return F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"),
    )


def relative_uri(path: Column, root: str | None = None) -> Column:
    """A path as reports cite it: forward slashes, relative to the project's ``root`` if it is
    absolute (with '..' parts where it lies outside); without a root leading slashes go."""
    path = F.replace(path, F.lit("\\"), F.lit("/"))
    if root is None:
        return F.regexp_replace(path, r"^/+", "")
    top = [p for p in posixpath.normpath(root.replace("\\", "/")).split("/") if p]

    def inside(parts: Column) -> Column:
        # How many of the root's parts the path begins with.
        same = [F.slice(parts, 1, k) == F.array(*[F.lit(p) for p in top[:k]]) for k in range(1, len(top) + 1)]
        n = F.lit(0)
        for k, holds in enumerate(same, 1):
            n = F.when(holds, F.lit(k)).otherwise(n)
        return once(n, lambda n: F.array_join(
            F.concat(
                F.array_repeat(F.lit(".."), F.lit(len(top)) - n), F.slice(parts, n + 1, F.greatest(F.size(parts), F.lit(1)))
            ), "/",
        ))

    def cited(path: Column) -> Column:
        within = once(F.filter(F.split(clean_path(path), "/"), lambda p: p != ""), inside)
        named = once(within, lambda w: F.when(w == "", F.lit(".")).otherwise(w))
        return F.when(F.startswith(path, F.lit("/")), named).otherwise(path)

    return once(path, cited)


def ancestor_dirs(path: Column) -> Column:
    """Every folder above a file, '.' for the root included."""
    parts = F.split(path, "/")
    above = F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda n: F.when(n == 0, F.lit(".")).otherwise(F.array_join(F.slice(parts, F.lit(1), n), "/")),
    )
    return above


def in_any_dir(path: Column, names: Sequence[str]) -> Column:
    """One of the folders above the file has one of the names."""
    return F.rlike(path, F.lit("(?:^|/)(?:" + "|".join(re.escape(n) for n in names) + ")/"))
