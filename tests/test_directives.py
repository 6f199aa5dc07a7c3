"""Suppression directives: per branch of a rule, per kind of secret, never for whole-file conditions."""

import re

import pytest

from ambersift.operators import file_checks, rules
from ambersift.operators.directives import apply_inline_suppressions
from ambersift.operators.rules import Rule
from ambersift.operators.scan import file_results


def scan(spark, text, rule, directive="scan"):
    files = spark.createDataFrame([("p", "a.py", text)], "project string, path string, content string")
    return [(r.rule_id, r.line) for r in rules.scan_rules(files, [rule], directive=directive).collect()]


def sub(pattern, rule_id=""):
    return Rule(id=rule_id, target="all", pattern=pattern)


OR = Rule(id="R", extensions=(".py",), pattern_either=(sub("alpha"), sub("beta", "R-B"), sub("gamma")))
AND = Rule(id="R", extensions=(".py",), patterns=(sub("alpha"), sub("beta", "R-B")))
NOT = Rule(id="R", extensions=(".py",), target="all", pattern="alpha", pattern_not="beta")
ONLY_NOT = Rule(id="R", extensions=(".py",), target="all", pattern_not="beta")
ONE = Rule(id="R", extensions=(".py",), target="all", pattern="alpha")
SHARE = Rule(id="R", extensions=(".py",), target="all", pattern="alpha", condition="threshold:0.1")
BIG = Rule(id="R", extensions=(".py",), target="condition", condition="large_file")
CASES = [
    # A hidden branch is not found: the next one is tried.
    (OR, "alpha # scan:ignore R\nx\nx\nbeta", [("R", 4)]),
    # A branch without an id of its own is hidden by any mark, one with an id only by that one.
    (OR, "alpha # scan:ignore other\nx\nbeta # scan:ignore other\ngamma", [("R", 3)]),
    (OR, "alpha # scan-ignore\nx\nbeta # scan-ignore: R-B\nx\ngamma", [("R", 5)]),
    (OR, "alpha # scan-ignore\nx\nbeta # scan-ignore: all\nx\n# scan:ignore q\ngamma", []),
    (AND, "alpha\nx\nbeta # scan:ignore R-B", []),
    (AND, "alpha\nx\nbeta # scan:ignore R-C", [("R", 1)]),
    # What is hidden does not negate.
    (NOT, "alpha\nx\nbeta # scan:ignore R", [("R", 1)]),
    (NOT, "alpha\nx\nbeta # scan:ignore Q", []),
    (NOT, "alpha # scan:ignore R\nx\nx", []),
    (ONLY_NOT, "x # scan:ignore all\nbeta # scan:ignore R", [("R", 1)]),
    # Same line, line before; not two lines before; only the first match counts.
    (ONE, "# scan-ignore-next-line: R\nalpha", []),
    (ONE, "# scan-ignore: R\nx\nalpha", [("R", 3)]),
    (ONE, "alpha # scan:ignore R\nalpha", []),
    (ONE, "alpha # scan-ignore: S\nalpha", [("R", 1)]),
    (ONE, "alpha # call scan-ignore", []),
    (SHARE, "alpha # scan:ignore R\nx", []),
    (SHARE, "alpha # scan:ignore S\nx", [("R", 1)]),
    # The file mark counts in the first ten lines.
    (ONE, "x\n" * 9 + "# scan:ignore-file\nalpha", []),
    (ONE, "x\n" * 10 + "# scan:ignore-file\nx\nalpha", [("R", 13)]),
    (OR, "# scan-ignore-file\nx\nalpha\nbeta\ngamma", []),
    (BIG, "# scan-ignore-file\n" + "x\n" * 1600, [("R", 1)]),
    (BIG, "x # scan:ignore all\n" + "x\n" * 1600, [("R", 1)]),
    (ONE, "", []),
]


@pytest.mark.parametrize("k", range(len(CASES)))
def test_directive(spark, k):
    rule, text, want = CASES[k]
    assert scan(spark, text, rule) == want


def test_other_tool_and_no_directives(spark):
    text = "alpha # scan:ignore R"
    assert scan(spark, text, ONE, "other") == [("R", 1)] and scan(spark, text, ONE, None) == [("R", 1)]
    assert scan(spark, "alpha # other:ignore R", ONE, "other") == []


KEY = "AKIA" + "ABCDEFGHIJ234567"
NAME = 'api_token = "Zx9qLk27TrWv81MnPs46"'


def secrets(spark, text, directive="scan"):
    files = spark.createDataFrame([("p", "a.py", text)], "project string, path string, content string")
    return {(r.line, r.rule_id) for r in file_checks.secret_assignments(files, directive).collect()}


def test_secrets(spark):
    leak, own = file_checks.LEAK_ID, file_checks.SECRET_ID
    assert secrets(spark, f"{KEY}\n{NAME}\nx\n{NAME} # scan:ignore all") == {(1, own), (2, own)}
    logged = f"{NAME}\nprint(api_token)\n"
    assert secrets(spark, logged) == {(1, leak)}
    for mark in (leak, own, "all"):
        assert secrets(spark, f"# scan-ignore: {mark}\n{logged}") == set()
    assert secrets(spark, f"# scan-ignore: {leak}\n{NAME}") == {(2, own)}
    assert secrets(spark, f"# scan-ignore-file\n\n{logged}{KEY}") == set()
    assert secrets(spark, f"# scan-ignore-file\n\n{logged}", None) == {(3, leak)}


def test_scan_keeps_large_files_and_hides_secrets(spark):
    text = "# scan-ignore-file\n" + NAME + "\n" + "x\n" * 1600
    files = spark.createDataFrame([("p", "a.py", text)], "project string, path string, content string")
    assert [r.rule_id for r in file_results(files, [ONE]).collect()] == ["CORE-LARGE"]


def test_index_joins_without_texts(spark):
    """Hits and the marked lines of files meet; no content is exchanged."""
    files = spark.createDataFrame(
        [("p", "a.py", "# scan:ignore R\nalpha\n" + "long text " * 500), ("p", "b.py", "alpha"), ("p", "c.py", "# scan-ignore-file")],
        "project string, path string, content string",
    )
    hits = spark.createDataFrame(
        [("p", "a.py", "R", 2), ("p", "a.py", "S", 2), ("p", "b.py", "R", 1), ("p", "c.py", "R", 9), ("p", "c.py", "BIG", 1)],
        "project string, path string, rule_id string, line int",
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = apply_inline_suppressions(hits, files, exempt=("BIG",))
        assert {(r.path, r.rule_id) for r in out.collect()} == {("a.py", "S"), ("b.py", "R"), ("c.py", "BIG")}
        plan = spark._jvm.PythonSQLUtils.explainString(out._jdf.queryExecution(), "formatted")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    moved = re.findall(r"\) Exchange\nInput \[\d+\]: (.*)", plan)
    assert any("_marks" in cols for cols in moved) and not any("content" in cols for cols in moved)
