"""Rules over text corpora: one pass per file, project rules as one aggregate.

A rule becomes a Column expression. All rules of a scan sit in one array per
file, so the corpus is read once and content is never shuffled or copied per
rule; the array is cut to its hits before it is exploded.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import base_name, dir_name, exclude_paths, ext_match, extension, is_test_like, kind_match
from ..functions.text import all_of, any_of, contains_any, lines_of, newline_count
from ..session import written
from .code_text import split_code_docs
from .directives import Hidden, directive_index, hidden_by, never
from .roots import assign_project
from .unroll import unrolled

PROJECT_CONDITIONS = ("missing_lockfile", "missing", "required_pattern")
GOD_FILE_LINES = 1500


@dataclass(frozen=True)
class Rule:
    id: str
    name: str = ""
    stack: str = "universal"
    extensions: tuple[str, ...] = ()
    target: str = ""
    pattern: str = ""
    condition: str = ""
    files: tuple[str, ...] = ()
    exclude_tests: bool = False
    exclude_paths: tuple[str, ...] = ()
    suggestion: str = ""
    severity: str = "LOW"
    patterns: tuple["Rule", ...] = ()
    pattern_either: tuple["Rule", ...] = ()
    pattern_not: str = ""
    mode: str = ""
    languages: tuple[str, ...] = field(default=())
    # Optional hint: words (any case) of which every match holds at least one. A byte
    # search for them keeps the regex off most files.
    needs: tuple[str, ...] = ()

    @property
    def is_project_rule(self) -> bool:
        return self.condition in PROJECT_CONDITIONS


def rules_df(spark: SparkSession, rules: Sequence[Rule]) -> DataFrame:
    rows = [
        (r.id, r.name, r.stack, list(r.extensions), r.target, r.pattern, r.condition, list(r.files),
         r.exclude_tests, list(r.exclude_paths), r.suggestion, r.severity)
        for r in rules
    ]
    return spark.createDataFrame(
        rows,
        "id string, name string, stack string, extensions array<string>, target string, pattern string,"
        " condition string, files array<string>, exclude_tests boolean, exclude_paths array<string>,"
        " suggestion string, severity string",
    )


def rules_for_stack(rules: DataFrame, stack: str) -> DataFrame:
    return rules.filter(F.col("stack").isin("universal", stack))


# ---- patterns -------------------------------------------------------------

_META = re.compile(r"[\\^$.|?*+()\[\]{}]")
# Constructs a linear-time regex dialect rejects: look-around and back-references.
_NOT_LINEAR = re.compile(r"\(\?<?[=!]|\\[1-9]")


def is_literal(pattern: str) -> bool:
    return not _META.search(pattern)


def java_pattern(pattern: str) -> str:
    """The rule dialect in Java terms: '.' stops at \\n only, a final '$' means end of text."""
    multiline = re.match(r"\(\?[a-z]*m", pattern)
    if not multiline and pattern.endswith("$") and not pattern.endswith(r"\$"):
        pattern = pattern[:-1] + r"\z"
    return "(?d)" + pattern


def matches(text: Column, pattern: str, compat: bool = False) -> Column:
    if is_literal(pattern) or (compat and _NOT_LINEAR.search(pattern)):
        return F.contains(text, F.lit(pattern))
    return F.rlike(text, F.lit(java_pattern(pattern)))


def match_position(text: Column, pattern: str, compat: bool = False) -> Column:
    """1-based place of the first match, 0 if there is none."""
    if is_literal(pattern) or (compat and _NOT_LINEAR.search(pattern)):
        return F.instr(text, F.lit(pattern))
    return F.regexp_instr(text, F.lit(java_pattern(pattern)))


def _hinted(rule: Rule, text: Column) -> Column:
    return contains_any(F.lower(text), [w.lower() for w in rule.needs]) if rule.needs else F.lit(True)


def line_at(text: Column, position: Column) -> Column:
    return newline_count(F.left(text, position - 1)) + 1


def _threshold_line(text: Column, pattern: str, share: float) -> Column:
    lines = lines_of(text)
    hit = F.transform(lines, lambda s: matches(s, pattern))
    n = F.size(F.filter(hit, lambda b: b))
    over = n / F.size(lines) > F.lit(float(share))
    return F.when(over, F.array_position(hit, True)).otherwise(0)


# ---- compiling a rule -----------------------------------------------------


def _target(rule: Rule, compat: bool) -> Column:
    if rule.target in ("all", "raw") or (rule.target == "lines_percentage" and not compat):
        return F.col("content")
    if rule.target == "docs":
        return F.col("docs")
    if rule.target == "filename" and not compat:
        return base_name(F.col("path"))
    return F.col("code")


def _needs_views(rule: Rule, compat: bool) -> bool:
    if rule.patterns or rule.pattern_either:
        return any(_needs_views(s, compat) for s in rule.patterns + rule.pattern_either)
    plain = ("all", "raw", "condition") + (() if compat else ("lines_percentage", "filename"))
    return rule.target not in plain


def _own_guard(rule: Rule, is_test: Column) -> Column:
    conds = []
    if rule.exclude_tests:
        conds.append(~is_test)
    if rule.exclude_paths:
        conds.append(~exclude_paths(F.col("path"), rule.exclude_paths))
    return all_of(conds)


def _shown(found: Column, line: Column, hidden: Hidden, rule_id: str) -> Column:
    """``line`` where something was found and no directive hides it, else 0."""
    if hidden is never:
        return F.when(found, line).otherwise(0)
    # A one-element array: the line is worked out once and then asked about.
    seen = F.filter(F.array(line), lambda n: ~hidden(n, F.lit(rule_id)))
    return F.when(found, F.coalesce(F.get(seen, F.lit(0)), F.lit(0))).otherwise(0)


def rule_line(rule: Rule, is_test: Column, compat: bool = False, hidden: Hidden = never) -> Column:
    """Line of the rule's hit in a file, 0 if it does not fire.

    Directives are asked for each pattern by itself, with the id of the (sub-)rule that
    states it: a hidden branch counts as not found, so an OR goes on to its next one and
    a negation holds. Conditions on the whole file are never hidden."""
    guard = _own_guard(rule, is_test)
    if rule.patterns:
        subs = [rule_line(s, is_test, compat, hidden) for s in rule.patterns]
        return F.when(guard & all_of([s > 0 for s in subs]), subs[0]).otherwise(0)
    if rule.pattern_either:
        subs = [rule_line(s, is_test, compat, hidden) for s in rule.pattern_either]
        return F.when(guard, F.coalesce(*[F.nullif(s, F.lit(0)) for s in subs], F.lit(0))).otherwise(0)
    if rule.pattern_not:
        absent = rule_line(replace(rule, pattern=rule.pattern_not, pattern_not=""), is_test, compat, hidden) == 0
        found = F.lit(1) if not rule.pattern else rule_line(replace(rule, pattern_not=""), is_test, compat, hidden)
        return F.when(absent, found).otherwise(0)
    if rule.target == "condition":
        big = newline_count(F.col("content")) > GOD_FILE_LINES
        return F.when(guard & F.lit(rule.condition == "large_file") & big, 1).otherwise(0)
    if rule.target == "ast" or not rule.pattern:
        return F.lit(0)
    text = _target(rule, compat)
    kind, _, arg = rule.condition.partition(":")
    if kind == "not_contains":
        guard = guard & ~F.contains(F.lower(text), F.lit(arg.lower()))
    elif kind == "contains" and not compat:
        guard = guard & F.contains(F.col("content"), F.lit(arg))
    if kind == "threshold" and not compat:
        return _shown(guard, _threshold_line(text, rule.pattern, float(arg)).cast("int"), hidden, rule.id)
    pos = match_position(text, rule.pattern, compat)
    return _shown(guard & _hinted(rule, text) & (pos > 0), line_at(text, pos), hidden, rule.id)


def _is_simple(rule: Rule, compat: bool) -> bool:
    kind = rule.condition.partition(":")[0]
    plain = not (rule.patterns or rule.pattern_either or rule.pattern_not)
    return plain and rule.target not in ("condition", "ast") and bool(rule.pattern) and (
        compat or kind != "threshold"
    )


# ---- scanning -------------------------------------------------------------


def _line_of(text: Column) -> Callable[[Column], Column]:
    return lambda s: F.struct(s["rule_id"].alias("rule_id"), line_at(text, s["pos"]).cast("int").alias("line"))


def rule_hits(
    files: DataFrame, rules: Sequence[Rule], *, compat: bool = False, directive: str | None = "scan"
) -> DataFrame:
    """``files`` (project, path, content[, stack], ..) with ``hits``: an array of the (rule_id,
    line) that fire in a file, each at its first match. ``code`` and ``docs`` are taken as
    given if the files have them."""
    active = [r for r in rules if not r.is_project_rule]
    path = F.col("path")
    base = files.withColumns(
        {"_test": is_test_like(path), "_ext": extension(path), "_base": F.lower(base_name(path))}
    )
    if any(_needs_views(r, compat) for r in active) and "code" not in files.columns:
        base = split_code_docs(base)
    # Rules share few extension lists: one expression per list.
    kinds = {e: kind_match(F.col("_ext"), F.col("_base"), e) for e in {r.extensions for r in active}}
    gate = {r.id: kinds[r.extensions] for r in active}
    if "stack" in files.columns:
        gate = {
            r.id: gate[r.id] if r.stack == "universal" else gate[r.id] & (F.col("stack") == r.stack) for r in active
        }

    arrays = []
    simple: dict[str, list[Rule]] = {}
    texts: dict[str, Column] = {}
    for r in active:
        if _is_simple(r, compat):
            text = _target(r, compat)
            simple.setdefault(str(text), []).append(r)
            texts[str(text)] = text
    lowered = {
        key: f"_low{i}" for i, (key, group) in enumerate(simple.items())
        if any(r.needs or r.condition.startswith("not_contains:") for r in group)
    }
    hidden = never
    if directive:
        # The index is null, and nothing is hidden, in most files.
        base = base.withColumn("_marks", directive_index(F.col("content"), directive))
        hidden = hidden_by(F.col("_marks"))
    # Lower-case text is made once per file, not once per rule that looks into it.
    base = base.withColumns({name: F.lower(texts[key]) for key, name in lowered.items()})
    for key, group in simple.items():
        text, spots = texts[key], []
        low = F.col(lowered[key]) if key in lowered else None
        for r in group:
            guard = gate[r.id] & _own_guard(r, F.col("_test"))
            kind, _, arg = r.condition.partition(":")
            if kind == "contains" and not compat:
                guard = guard & F.contains(F.col("content"), F.lit(arg))
            if kind == "not_contains":
                guard = guard & ~F.contains(low, F.lit(arg.lower()))
            if r.needs:
                guard = guard & contains_any(low, [w.lower() for w in r.needs])
            pos = F.when(guard, match_position(text, r.pattern, compat)).otherwise(0)
            spots.append(F.struct(F.lit(r.id).alias("rule_id"), pos.alias("pos")))
        found = F.filter(F.array(*spots), lambda s: s["pos"] > 0)
        found = F.transform(found, _line_of(text))
        if directive:
            found = F.filter(found, lambda h: ~hidden(h["line"], h["rule_id"]))
        arrays.append(found)
    other = [r for r in active if not _is_simple(r, compat)]
    if other:
        spots = [
            F.struct(
                F.lit(r.id).alias("rule_id"),
                F.when(gate[r.id], rule_line(r, F.col("_test"), compat, hidden)).otherwise(0).cast("int").alias("line"),
            )
            for r in other
        ]
        arrays.append(F.filter(F.array(*spots), lambda s: s["line"] > 0))
    none = F.array().cast("array<struct<rule_id:string,line:int>>")
    hits = F.concat(*arrays) if len(arrays) > 1 else arrays[0] if arrays else none
    return base.select(*files.columns, hits.alias("hits"))


def scan_rules(
    files: DataFrame, rules: Sequence[Rule], *, compat: bool = False, directive: str | None = "scan"
) -> DataFrame:
    """(project, path, content[, stack]) -> one row per (file, rule) hit at its first match."""
    files = files.select(*[c for c in files.columns if c in ("project", "path", "content", "stack")])
    out_cols = [c for c in files.columns if c != "content"]
    found = rule_hits(files, rules, compat=compat, directive=directive)
    flat = unrolled(found, out_cols, "hits", "h").select(*out_cols, "h.rule_id", "h.line")
    return with_rule_details(flat, [r for r in rules if not r.is_project_rule])


def with_rule_details(hits: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Name, severity and suggestion next to the rule id: constants of the plan, like the
    rules themselves."""
    rows = {r.id: (r.id, r.name, r.severity, r.suggestion) for r in reversed(rules)}
    details = hits.sparkSession.createDataFrame(
        list(rows.values()), "rule_id string, name string, severity string, suggestion string"
    )
    return hits.join(F.broadcast(details), "rule_id", "left")


def rules_x_files(files: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Candidate (file, rule) pairs by extension or base name and stack; no join, no shuffle."""
    path = F.col("path")
    keep = [n for n in files.columns if n in ("project", "path", "stack")]
    files = files.select(*keep, extension(path).alias("_ext"), F.lower(base_name(path)).alias("_base"))
    ids = []
    for r in rules:
        cond = kind_match(F.col("_ext"), F.col("_base"), r.extensions)
        if "stack" in files.columns and r.stack != "universal":
            cond = cond & (F.col("stack") == r.stack)
        ids.append(F.when(cond, F.lit(r.id)))
    return files.select("project", "path", F.explode(F.array_compact(F.array(*ids))).alias("rule_id"))


# ---- project rules --------------------------------------------------------


def _candidate(rule: Rule, is_test: Column) -> Column:
    return ext_match(F.col("path"), rule.extensions) & _own_guard(rule, is_test)


def _per_project(files: DataFrame, flags: dict[str, Column], keys: Sequence[str] = ("project",)) -> DataFrame:
    """Boolean ORs per project: partial aggregates, so content never moves."""
    if not flags:
        return files.select(*keys).distinct()
    return files.groupBy(*keys).agg(*[F.max(F.coalesce(c, F.lit(False))).alias(n) for n, c in flags.items()])


def _per_root(files: DataFrame, flags: dict[str, Column], roots: DataFrame) -> DataFrame:
    """The same per root, of the files assigned to it. Flags are worked out where the
    text is read; what is joined are paths and flags."""
    marks = files.select("project", "path", *[F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()])
    marks = marks.filter(any_of([F.col(n) for n in flags]))
    mine = assign_project(files.select("project", "path"), roots).filter(F.col("root").isNotNull()).select("project", "path", "root")
    found = _per_project(marks.join(mine, ["project", "path"]), {n: F.col(n) for n in flags}, ("project", "root"))
    return roots.select("project", "root", "stack").join(found, ["project", "root"], "left").fillna(False, list(flags))


def _fired(per: DataFrame, rules: Sequence[Rule], fires: Sequence[Column]) -> DataFrame:
    """One row per rule that fires; per root only rules of the root's stack do."""
    keys = [c for c in ("project", "root", "stack") if c in per.columns]
    if "stack" in keys:
        fires = [c if r.stack == "universal" else c & (F.col("stack") == r.stack) for r, c in zip(rules, fires)]
    ids = F.array_compact(F.array(*[F.when(c, F.lit(r.id)) for r, c in zip(rules, fires)]).cast("array<string>"))
    return with_rule_details(per.select(*keys, F.explode(ids).alias("rule_id")), rules)


def with_required_flags(files: DataFrame, rules: Sequence[Rule]) -> tuple[DataFrame, list[str]]:
    """``files`` with two flags for each required pattern (is a candidate, matches), and their names."""
    rules = [r for r in rules if r.condition == "required_pattern"]
    base = files.withColumn("_test", is_test_like(F.col("path")))
    if any(r.target in ("code", "docs") for r in rules) and "code" not in files.columns:
        base = split_code_docs(base)
    flags = {}
    for i, r in enumerate(rules):
        text = F.col(r.target if r.target in ("code", "docs") else "content")
        cand = _candidate(r, F.col("_test"))
        flags[f"c{i}"] = cand
        flags[f"m{i}"] = F.when(cand, matches(text, r.pattern))
    return base.select(*files.columns, *[F.coalesce(c, F.lit(False)).alias(n) for n, c in flags.items()]), list(flags)


def required_missing(flagged: DataFrame, rules: Sequence[Rule], roots: DataFrame | None = None) -> DataFrame:
    """Required patterns that no candidate of a project (or root) holds; ``flagged`` has the
    flags of ``with_required_flags``, but needs no texts."""
    rules = [r for r in rules if r.condition == "required_pattern"]
    flags = {f"{n}{i}": F.col(f"{n}{i}") for i in range(len(rules)) for n in "cm"}
    fires = [F.col(f"c{i}") & ~F.col(f"m{i}") for i in range(len(rules))]
    return _fired(_per_project(flagged, flags) if roots is None else _per_root(flagged, flags, roots), rules, fires)


def required_pattern(files: DataFrame, rules: Sequence[Rule], roots: DataFrame | None = None) -> DataFrame:
    """Projects with candidate files of which none matches; with ``roots`` (project, root,
    stack) every root by itself, for rules of its stack.

    Flags and roots are asked more than once there, so both are written."""
    flagged, names = with_required_flags(files, rules)
    flagged = flagged.select("project", "path", *names)
    return required_missing(flagged, rules) if roots is None else required_missing(written(flagged), rules, written(roots))


def missing_filename(
    files: DataFrame, projects: DataFrame, rules: Sequence[Rule], roots: DataFrame | None = None
) -> DataFrame:
    """Projects (with ``roots``: roots) without a file of the listed kinds whose base name matches."""
    rules = [r for r in rules if r.condition == "missing" and r.target == "filename"]
    flags = {
        f"f{i}": ext_match(F.col("path"), r.extensions) & matches(base_name(F.col("path")), r.pattern)
        for i, r in enumerate(rules)
    }
    if roots is None:
        per = projects.select("project").distinct().join(_per_project(files, flags), "project", "left")
    else:
        per = _per_root(files, flags, roots)
    fires = [~F.coalesce(F.col(f"f{i}"), F.lit(False)) for i in range(len(rules))]
    return _fired(per, rules, fires)


def missing_lockfile(
    files: DataFrame, projects: DataFrame, rules: Sequence[Rule], roots: DataFrame | None = None
) -> DataFrame:
    """Projects with none of the rule's lock files at their top; with ``roots`` every root by itself."""
    rules = [r for r in rules if r.condition == "missing_lockfile"]
    wanted = sorted({f for r in rules for f in r.files})
    if roots is None:
        at_root = files.filter(F.col("path").isin(wanted))
        found = _per_project(at_root, {f"f{i}": F.col("path").isin(list(r.files)) for i, r in enumerate(rules)})
        per = projects.select("project").distinct().join(found, "project", "left")
    else:
        base = base_name(F.col("path"))
        held = files.filter(base.isin(wanted)).select("project", dir_name(F.col("path")).alias("root"), base.alias("name"))
        flags = {f"f{i}": F.col("name").isin(list(r.files)) for i, r in enumerate(rules)}
        per = roots.select("project", "root", "stack").join(
            _per_project(held, flags, ("project", "root")), ["project", "root"], "left"
        )
    fires = [~F.coalesce(F.col(f"f{i}"), F.lit(False)) for i in range(len(rules))]
    return _fired(per, rules, fires)


# ---- non-functional requirements -----------------------------------------


@dataclass(frozen=True)
class NfrRule:
    id: str
    name: str
    severity: str
    check: str
    pattern: str
    files: tuple[str, ...] = ()
    applies_pattern: str = ""
    applies_files: tuple[str, ...] = ()
    message: str = ""
    advice: str = ""


# Folders that never count as project content.
NFR_SKIP_DIRS = (".git", "node_modules", "vendor", "dist", "build", ".next")


def glob_pattern(glob: str) -> str:
    out = "".join({"*": "[^/]*", "?": "[^/]"}.get(ch, re.escape(ch)) for ch in glob)
    return rf"^{out}\z"


def _any_glob(path: Column, globs: Sequence[str]) -> Column:
    return any_of([F.rlike(base_name(path), F.lit(glob_pattern(g))) for g in globs])


def nfr_rules(files: DataFrame, projects: DataFrame, rules: Sequence[NfrRule]) -> DataFrame:
    """Violated requirements per project: applies-gate, then presence or absence."""
    path, content = F.col("path"), F.col("content")
    skipped = any_of([F.contains(F.concat(F.lit("/"), path), F.lit(f"/{d}/")) for d in NFR_SKIP_DIRS])
    flags = {}
    for i, r in enumerate(rules):
        gate_globs = r.applies_files or r.files
        if r.applies_pattern:
            flags[f"a{i}"] = F.when(~skipped & _any_glob(path, gate_globs), matches(content, r.applies_pattern))
        if r.check == "file_contains":
            target = ~skipped & _any_glob(path, r.files)
            flags[f"t{i}"] = target
            flags[f"m{i}"] = F.when(target, matches(content, r.pattern))
        else:
            flags[f"e{i}"] = path == r.pattern
    per = projects.select("project").distinct().join(_per_project(files, flags), "project", "left").fillna(False)
    fires = []
    for i, r in enumerate(rules):
        applies = F.col(f"a{i}") if r.applies_pattern else F.lit(True)
        if r.check == "file_contains":
            fires.append(applies & F.col(f"t{i}") & ~F.col(f"m{i}"))
        else:
            there = F.col(f"e{i}")
            fires.append(applies & (~there if r.check == "file_exists" else there))
    ids = F.array_compact(F.array(*[F.when(c, F.lit(r.id)) for r, c in zip(rules, fires)]))
    flat = per.select("project", F.explode(ids).alias("rule_id"))
    details = files.sparkSession.createDataFrame(
        [(r.id, r.name, r.severity, r.message, r.advice) for r in rules],
        "rule_id string, name string, severity string, message string, advice string",
    )
    return flat.join(F.broadcast(details), "rule_id")
