"""Scans with rules read from catalog files, packs and custom rules.

The SQL states the rules it expects a second time, apart from the files."""

from __future__ import annotations

from pathlib import Path

from ..operators import rules as R
from ..operators.rules import Rule
from ..sources.rules import load_rules
from . import duck as D
from .corpus_q import _rule_rows
from .registry import query

CATALOG = Path(__file__).parent / "catalog"

EVAL = Rule(id="CAT-EVAL", name="eval", extensions=(".py", ".js"), pattern=r"eval\(", severity="HIGH", suggestion="avoid eval")
DEBUG = Rule(id="CAT-DEBUG", name="debug", extensions=(".py",), pattern=r"(?i)debug\s*=", severity="LOW", suggestion="switch it off")
TOTAL = Rule(id="PACK-TOTAL", name="total", extensions=(".go", ".md"), pattern=r"total =", severity="MEDIUM", suggestion="check totals")
OWN = Rule(id="OWN-TODO", name="todo", extensions=(".py", ".go"), pattern=r"TODO", severity="LOW", suggestion="do it")
CUSTOM = {
    "id": "OWN-TODO", "name": "todo", "stack": "universal", "extensions": [".py", ".go"], "target": "all", "pattern": "TODO",
    "severity": "LOW", "suggestion": "do it",
}


def _sql(*rules: Rule) -> str:
    return f"SELECT * FROM ({_rule_rows(rules, 'code_files', lambda r: D.hit_line('content', r.pattern))}) WHERE line > 0"


def _scan(t, *args, **kw):
    return R.scan_rules(t.code_files, load_rules(*args, **kw), directive=None)


@query("load_rules", _sql(EVAL, DEBUG))
def _(t):
    return _scan(t, [CATALOG / "core"])


@query("rule_packs", _sql(EVAL, DEBUG, TOTAL))
def _(t):
    """The catalog's rule of an id wins over the pack's."""
    return _scan(t, [CATALOG / "core", CATALOG / "pack" / "pack.json"])


@query("custom_rules", _sql(DEBUG, TOTAL, OWN))
def _(t):
    return _scan(t, [CATALOG / "core", CATALOG / "pack"], custom=[CUSTOM], ignored=["CAT-EVAL"])
