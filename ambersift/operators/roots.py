"""Project roots and their stacks, and the files that belong to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import ancestor_dirs, base_name, dir_name, extension, is_test_like
from ..functions.text import first_where
from ..session import written

# Stack names and the points of their marker files.
GENERIC = "unknown"
EXPRESS_IMPORT = r"""(?m)(?:\bfrom\s*["']express["']|\brequire\s*\(\s*["']express["']\s*\))"""
SCRIPT_EXTS = (".js", ".cjs", ".mjs", ".ts", ".tsx")
MIN_STACK_POINTS, MIN_GENERIC_POINTS = 80, 50
_EXPRESS_IF_USED = "express?"  # settled once it is known where the package is imported


def json_names(content: Column, *sections: str) -> Column:
    """Dependency names in the named sections of a JSON manifest; empty if it does not parse."""
    ddl = ", ".join(f"{s} map<string,string>" for s in sections)
    doc = F.from_json(content, ddl)
    keys = [F.coalesce(F.map_keys(doc[s]), F.array().cast("array<string>")) for s in sections]
    return F.array_distinct(F.concat(*keys))


def imports_express(path: Column, content: Column) -> Column:
    """An import proves the dependency wherever it stands, tests included."""
    return extension(path).isin(*SCRIPT_EXTS) & F.contains(content, F.lit("express")) & F.rlike(content, F.lit(EXPRESS_IMPORT))


def stack_points(path: Column, content: Column) -> Column:
    """Array of the (stack, points) of a marker file, null for all others."""
    base, low = base_name(path), F.lower(content)

    def points(stack: str, n: int) -> Column:
        return F.struct(F.lit(stack).alias("stack"), F.lit(n).alias("points"))

    deps = json_names(content, "dependencies", "devDependencies")
    in_requirements = F.contains(dir_name(path), F.lit("requirements"))
    python_deps = base.isin("requirements.txt", "pyproject.toml", "Pipfile") | (
        in_requirements & F.rlike(base, F.lit(r"\.(?:txt|in)\z"))
    )

    def has(word: str) -> Column:
        return F.contains(low, F.lit(word))

    def imports(word: str) -> Column:
        return has(f"from {word}") | has(f"import {word}")

    manifest = F.when(
        base == "package.json",
        F.when(F.array_contains(deps, "next"), points("nextjs", 100))
        .when(F.array_contains(deps, "express"), points(_EXPRESS_IF_USED, 100))
        .otherwise(points(GENERIC, 50)),
    )
    python = F.when(
        python_deps,
        first_where(
            [(has(w), points(w, 100)) for w in ("fastapi", "django", "flask")], points(GENERIC, 50)
        ),
    )
    entry = F.when(
        base.isin("main.py", "app.py", "asgi.py"),
        first_where([(imports(w), points(w, 80)) for w in ("fastapi", "django", "flask")]),
    )
    dotnet = F.when(
        F.rlike(base, F.lit(r"\.(?:csproj|fsproj)\z"))
        & (
            (F.contains(content, F.lit("PackageReference")) & F.contains(content, F.lit("Microsoft.AspNetCore")))
            | F.rlike(content, F.lit(r"""Sdk=["']Microsoft\.NET\.Sdk\.Web["']"""))
        ),
        points("aspnetcore", 100),
    )
    others = [
        F.when(base.isin("next.config.js", "next.config.mjs"), points("nextjs", 80)),
        F.when(base == "tsconfig.json", points(GENERIC, 20)),
        F.when(base == "manage.py", points("django", 90)),
        F.when(base == "go.mod", points("go", 100)),
    ]
    marker = (
        base.isin("package.json", "next.config.js", "next.config.mjs", "tsconfig.json", "manage.py", "go.mod",
                  "main.py", "app.py", "asgi.py")
        | python_deps
        | F.rlike(base, F.lit(r"\.(?:csproj|fsproj)\z"))
    )
    return F.when(marker & ~is_test_like(path), F.array_compact(F.array(manifest, python, entry, dotnet, *others)))


def detect_stack(files: DataFrame) -> DataFrame:
    """Winning stack of each folder by the points of its marker files.

    A project in which no folder wins is one root of no known stack, so none of its
    files is lost. Manifests are scored where they are read, once: what is written and asked
    from then on are paths and points."""
    path, content = F.col("path"), F.col("content")
    marked = files.select("project", "path", imports_express(path, content).alias("express"), stack_points(path, content).alias("points"))
    return settle_stacks(written(marked))


def settle_stacks(marked: DataFrame) -> DataFrame:
    """``detect_stack`` from (project, path, express, points) of every file; no texts."""
    path = F.col("path")
    express_dirs = marked.filter("express").select("project", F.explode(ancestor_dirs(path)).alias("dir")).distinct()
    scored = marked.select("project", dir_name(path).alias("dir"), F.explode("points").alias("s")).select(
        "project", "dir", "s.stack", "s.points"
    )
    # What moves from here on are points.
    asked, used = F.col("stack") == _EXPRESS_IF_USED, F.col("_express").isNotNull()
    settled = scored.join(express_dirs.withColumn("_express", F.lit(True)), ["project", "dir"], "left").select(
        "project", "dir",
        F.when(asked & used, F.lit("express")).when(asked, F.lit(GENERIC)).otherwise(F.col("stack")).alias("stack"),
        F.when(asked & ~used, 50).otherwise(F.col("points")).alias("points"),
    )
    sums = settled.groupBy("project", "dir", "stack").agg(F.sum("points").alias("points"))
    # Ties go to the first stack by name.
    best = sums.groupBy("project", "dir").agg(F.min(F.struct((-F.col("points")).alias("n"), "stack")).alias("b"))
    out = best.select("project", F.col("dir").alias("root"), F.col("b.stack").alias("stack"), (-F.col("b.n")).alias("points"))
    found = out.filter(
        (F.col("points") >= MIN_STACK_POINTS)
        | ((F.col("points") >= MIN_GENERIC_POINTS) & (F.col("stack") == GENERIC))
    )
    return marked.select("project").distinct().join(found, "project", "left").select(
        "project", F.coalesce("root", F.lit(".")).alias("root"), F.coalesce("stack", F.lit(GENERIC)).alias("stack"),
        F.coalesce("points", F.lit(0)).cast("long").alias("points"),
    )


def assign_project(files: DataFrame, roots: DataFrame) -> DataFrame:
    """Each live file to the deepest root above it: an equi-join on its ancestor folders.
    Files outside every root of their project have none: root and stack are null."""
    live = files.filter(~is_test_like(F.col("path"))).select("project", "path")
    up = live.select("project", "path", F.explode(ancestor_dirs(F.col("path"))).alias("root"))
    hits = up.join(roots.select("project", "root", F.coalesce("stack", F.lit(GENERIC)).alias("stack")), ["project", "root"], "left")
    level = F.when(F.col("stack").isNull(), -1).when(F.col("root") == ".", 0).otherwise(F.length("root"))
    best = hits.groupBy("project", "path").agg(F.max_by(F.struct("root", "stack"), level).alias("b"))
    inside = F.col("b.stack").isNotNull()
    return best.select("project", "path", F.when(inside, F.col("b.root")).alias("root"), "b.stack")
