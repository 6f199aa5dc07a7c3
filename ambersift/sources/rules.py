"""Rule catalogs from YAML or JSON files, read on the driver: a few hundred rows."""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import replace
from pathlib import Path

from ..operators.rules import NfrRule, Rule

try:
    import yaml
except ImportError:  # YAML catalogs need PyYAML; JSON catalogs do not.
    yaml = None

LEVELS = ("CRITICAL", "HIGH", "MEDIUM", "LOW")


def _load(path: Path):
    if path.suffix == ".json":
        return json.loads(path.read_text(encoding="utf-8"))
    if yaml is None:
        raise RuntimeError(f"PyYAML is needed to read {path}")
    return yaml.safe_load(path.read_text(encoding="utf-8"))


def _documents(root: str | Path) -> Iterable:
    root = Path(root)
    names = [root] if root.is_file() else sorted(p for p in root.rglob("*") if p.suffix in (".yaml", ".yml", ".json"))
    for path in names:
        try:
            doc = _load(path)
        except (ValueError, UnicodeDecodeError) as err:
            if yaml is None or not isinstance(err, (ValueError, UnicodeDecodeError)):
                raise
            continue
        except Exception as err:
            if yaml is not None and isinstance(err, yaml.YAMLError):
                continue
            raise
        yield doc


def rule_from_dict(d: dict) -> Rule:
    """A rule as a catalog states it. The search hint ``needs`` is not taken from files: a
    wrong one would silently drop hits."""

    def texts(name: str) -> tuple[str, ...]:
        return tuple(str(v) for v in d.get(name) or ())

    def subs(*names: str) -> tuple[Rule, ...]:
        return tuple(rule_from_dict(s) for n in names for s in d.get(n) or () if isinstance(s, dict))

    return Rule(
        id=str(d.get("id", "")), name=str(d.get("name", "")), stack=str(d.get("stack", "")),
        extensions=texts("extensions"), target=str(d.get("target", "")), pattern=str(d.get("pattern", "")),
        condition=str(d.get("condition", "")), files=texts("files"), exclude_tests=bool(d.get("exclude_tests")),
        exclude_paths=texts("exclude_paths"), suggestion=str(d.get("suggestion", "")),
        severity=str(d.get("severity", "")), patterns=subs("patterns"),
        pattern_either=subs("pattern-either", "pattern_either"),
        pattern_not=str(d.get("pattern-not", d.get("pattern_not", ""))), mode=str(d.get("mode", "")),
    )


def with_severity(rule: Rule) -> Rule:
    """Severity from the 'HIGH: ' prefix of the suggestion, else LOW."""
    if rule.severity:
        return rule
    head, sep, rest = rule.suggestion.partition(": ")
    if sep and head.upper() in LEVELS:
        return replace(rule, severity=head.upper(), suggestion=rest)
    return replace(rule, severity="LOW")


def read_rules(root: str | Path) -> list[Rule]:
    """Rules in file order, the first of each id; documentation and taint rules left out."""
    found: dict[str, Rule] = {}
    for doc in _documents(root):
        rows = doc.get("rules") if isinstance(doc, dict) else None
        for d in rows or ():
            rule = rule_from_dict(d)
            if rule.target != "entropy-analysis" and rule.mode != "taint":
                found.setdefault(rule.id, rule)
    return list(found.values())


def load_rules(
    paths: Sequence[str | Path], custom: Sequence[Rule | dict] = (), ignored: Sequence[str] = ()
) -> list[Rule]:
    """Catalog first, then packs (existing ids win), then custom rules; ignored ids drop out."""
    found: dict[str, Rule] = {}
    for i, root in enumerate(paths):
        for rule in read_rules(root):
            found.setdefault(rule.id, with_severity(rule) if i == 0 else rule)
    own = [r if isinstance(r, Rule) else rule_from_dict(r) for r in custom]
    return [r for r in [*found.values(), *own] if r.id not in set(ignored)]


def load_nfr_rules(paths: Sequence[str | Path]) -> list[NfrRule]:
    out = []
    for root in paths:
        for doc in _documents(root):
            for d in doc if isinstance(doc, list) else ():
                out.append(
                    NfrRule(
                        id=d["id"], name=d.get("name", ""), severity=d.get("severity", ""), check=d["check"],
                        pattern=d.get("pattern", ""), files=tuple(d.get("files") or ()),
                        applies_pattern=d.get("applies_pattern", ""),
                        applies_files=tuple(d.get("applies_files") or ()), message=d.get("message", ""),
                        advice=d.get("advice", ""),
                    )
                )
    return out
