"""Fix proposals: every finding gets one. Paths as reports cite them."""

import os.path
import posixpath

import pytest
from pyspark.sql import functions as F

from ambersift.functions.paths import relative_uri
from ambersift.operators.remedy import fix_proposals


@pytest.mark.parametrize("root", ["/srv/app", "/srv/app/", "/", "/srv//x/../app", "/srv/app/deep/er"])
def test_relative_uris(spark, root):
    paths = ["/srv/app/a.py", "/srv/app", "/srv/app/x/./y.py", "/srv/application/a.py", "/srv/b.py", "/", "/etc/x", "/srv/app/deep/a", "/srv/app//q"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    got = {r.p: r.u for r in df.select("p", relative_uri(F.col("p"), root).alias("u")).collect()}
    assert got == {p: posixpath.relpath(os.path.normpath(p), os.path.normpath(root)) for p in paths}
    other = spark.createDataFrame([("a/b.py",), ("a\\b.py",), ("",)], "p string")
    assert [r.u for r in other.select(relative_uri(F.col("p"), root).alias("u")).collect()] == ["a/b.py", "a/b.py", ""]
    assert df.select(relative_uri(F.col("p")).alias("u")).first().u == "srv/app/a.py"


def test_no_finding_is_dropped(spark):
    files = spark.createDataFrame(
        [
            ("p", "a.py", 'x = 1\napi_key = "abcdefgh1234"\nDEBUG = True\napp.run(debug=True)'), ("p", "b.go", "package b\nvar x = f()"),
            ("p", "c.js", 'const pw = "longsecret"'), ("p", "d.rb", 'pw = "longsecret"'), ("p", "plain.py", "x = 1"),
        ],
        "project string, path string, content string",
    )
    found = [
        ("p", "a.py", "ENTROPY-SECRET", 2), ("p", "a.py", "ENTROPY-SECRET", 2), ("p", "a.py", "ENTROPY-SECRET", 1),
        ("p", "a.py", "ENTROPY-SECRET", 9), ("p", "a.py", "ENTR-18", 3), ("p", "plain.py", "ENTR-18", 1), ("p", "b.go", "ENTR-17", 2),
        ("p", "c.js", "ENTR-17", 1), ("p", "d.rb", "ENTR-17", 1), ("p", "none.py", "ENTR-17", 1), ("p", "none.go", "ENTR-18", 1),
        ("p", "a.py", "FAST-CORS", 1), ("p", "x.ts", "FLASK-CORS", 0), ("p", "", "ENTR-02", 0), ("p", None, "ENTR-02", None),
        ("p", "a.py", "FAST-SSTI", 1), ("p", "a.py", "OTHER", 1), (None, "a.py", "ENTR-17", None),
    ]
    df = spark.createDataFrame(found, "project string, path string, rule_id string, line int")
    rows = fix_proposals(df, files).collect()
    assert {(r.project, r.path, r.rule_id, r.line) for r in rows} == set(found)
    got = {(r.path, r.rule_id, r.line, r.fix_line): (r.kind, r.after or r.advice) for r in rows}
    assert len(got) == len(rows) == len(set(found)) + 1
    assert got["a.py", "ENTROPY-SECRET", 2, 2] == ("rewrite", 'api_key = os.environ.get("API_KEY", "")')
    assert got["a.py", "ENTROPY-SECRET", 9, None] == ("failed", "the file has no such line")
    assert got["none.py", "ENTR-17", 1, None] == got["none.go", "ENTR-18", 1, None] == ("failed", "the file is not there")
    assert got["a.py", "ENTR-18", 3, 3][0] == got["a.py", "ENTR-18", 3, 4][0] == "rewrite"
    manual = {k[:2] for k, v in got.items() if v[0] == "manual"}
    assert manual == {
        ("a.py", "ENTROPY-SECRET"), ("plain.py", "ENTR-18"), ("b.go", "ENTR-17"), ("d.rb", "ENTR-17"), ("a.py", "FAST-CORS"),
        ("x.ts", "FLASK-CORS"), ("", "ENTR-02"), (None, "ENTR-02"), ("a.py", "FAST-SSTI"), ("a.py", "OTHER"),
    }
    assert "os.Getenv" in got["b.go", "ENTR-17", 2, None][1] and "lock file" in got["", "ENTR-02", 0, None][1]
