"""The scan through to the gate: one look at the texts, audit statuses, scores, clean projects."""

import re

import pytest
from pyspark.sql import functions as F

from ambersift.operators import scan as W
from ambersift.operators.health import PROFILES
from ambersift.operators.project_shape import (
    OPEN_COMPOSE, UNPACKED_ENV, deploy_audit, deploy_feed, detect_components, threat_recommendations,
)
from ambersift.operators.rules import Rule

FILES = "project string, path string, content string"
EVAL = Rule(id="T-EVAL", name="eval", extensions=(".py",), target="all", pattern=r"eval\(", severity="HIGH")
NEEDS = Rule(id="Q-LOG", name="logging", extensions=(".py",), target="all", pattern="import logging", severity="LOW", condition="required_pattern")


@pytest.fixture
def files(spark, tmp_path):
    rows = [
        ("a", "main.py", "from flask import Flask\neval(x)\n"), ("a", "old.py", "eval(y)\n"), ("a", "empty.py", None),
        ("a", "Dockerfile", "FROM x\nUSER root\n"), ("a", "tests/test_x.py", "eval(z)\n"),
        ("b", "app.py", "import logging\n"), ("b", ".env", ""),
        ("c", "docker-compose.yml", "image: postgres\n"), ("c", ".env", "X=1"),
    ]
    spark.createDataFrame(rows, FILES).write.parquet(str(tmp_path / "files"))
    return spark.read.parquet(str(tmp_path / "files"))


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString(), df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_read_by_one_scan_without_exchange(files):
    _, plan = _plan(W.file_facts(files, [EVAL, NEEDS]))
    assert len(re.findall(r"FileScan|Scan parquet", plan)) == 1 and "Exchange" not in plan
    results = W.results_of(W.written(W.file_facts(files, [EVAL, NEEDS])), [EVAL, NEEDS])
    assert "content" not in "".join(_plan(results))


def test_gate_counts_what_is_not_settled(spark, files):
    audit = spark.createDataFrame([("a", "T-EVAL", "old.py", "IGNORED"), ("b", "T-EVAL", "main.py", "IGNORED")],
                                  "project string, rule_id string, file string, status string")
    facts = W.written(W.file_facts(files, [EVAL, NEEDS]))
    got = {(r.rule_id, r.file): (r.source, r.audit_status) for r in W.audited_scan(facts, [EVAL, NEEDS], audit).filter("project = 'a'").collect()}
    assert got == {
        ("T-EVAL", "main.py"): ("core", "OPEN"), ("T-EVAL", "old.py"): ("core", "IGNORED"), ("Q-LOG", ""): ("core", "OPEN"),
        ("dockerfile_root_user", "Dockerfile"): ("deploy", "OPEN"),
    }
    gate = {(r.project, r.profile): r for r in W.scan_gate(files, [EVAL, NEEDS], audit, list(PROFILES.values())).collect()}
    assert gate["a", "baseline"].status == "failed" and gate["a", "baseline"].ignored_findings == 1
    # Two eval weights of 9.0 and 9.0 * 0.8, one of 1.0: 100 - 100 (1 - exp(-17.2 / 55)) = 73.
    assert gate["a", "baseline"].score == 73 and gate["a", "baseline"].active_findings == 3
    assert (gate["b", "strict"].status, gate["b", "strict"].score, gate["b", "strict"].grade) == ("passed", 100, "A+")


def test_results_of_no_files(spark):
    none = spark.createDataFrame([], FILES)
    audit = spark.createDataFrame([], "project string, rule_id string, file string, status string")
    assert W.scan_gate(none, [EVAL, NEEDS], audit, [PROFILES["strict"]]).count() == 0
    assert W.core_scan(none, [NEEDS]).count() == 0


def test_recommendations(spark, files):
    parts = detect_components(files, files.select("project").distinct())
    got = {(r.project, r.recommendation) for r in threat_recommendations(files, parts).collect()}
    assert got == {("b", UNPACKED_ENV), ("c", OPEN_COMPOSE)}
    proxy = files.withColumn("content", F.concat("content", F.lit("image: nginx\n")))
    parts = detect_components(proxy, files.select("project").distinct())
    assert {r.project for r in threat_recommendations(proxy, parts).collect()} == {"b"}


def test_deployment_findings_keep_the_line_and_chain(spark):
    line = "ENV API_KEY=" + "k" * 90
    files = spark.createDataFrame([("p", "Dockerfile", f"FROM x\n  {line}\n"), ("p", "Makefile", None)], FILES)
    row = deploy_audit(files).collect()[0]
    assert row.text == line and row.evidence == line[:50] + "..." and row.line == 2 and "hardcode" in row.advice
    assert deploy_feed(files).columns == ["project", "file", "line", "issue", "severity", "advice"]
