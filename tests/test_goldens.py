"""Exact values: literals with a known answer."""

import json

import pytest
from pyspark.sql import functions as F

from ambersift.functions import identity, paths, severity, text
from ambersift.operators import code_text, file_checks, health, rules, timeline
from ambersift.operators.rules import NfrRule, Rule
from ambersift.sources import corpus, stores
from ambersift.sources import rules as catalog


def values(spark, inputs, expr, types="v string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, {types}")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("v")).alias("o")).collect()]


def test_entropy(spark):
    words = ["", "hello world", "a1b2c3d4e5f6g7h8i9j0", "aaaa"]
    got = values(spark, words, text.shannon_entropy)
    assert got == pytest.approx([0.0, 2.845350936622437, 4.321928094887363, 0.0], abs=1e-9)


def test_high_entropy(spark):
    words = ["short", "a1b2c3d4e5f6g7h8i9j0", '"a1b2c3d4e5f6g7h8i9j0"', "x" * 129, "aaaaaaaaaaaaaaaaaaaa",
             "!@#$%^&*()!@#$%^&*()!@", "a1b2c3d4\x01e5f6g7h8i9j0"]
    assert values(spark, words, text.is_high_entropy) == [False, True, True, False, False, False, False]


def test_normalize_path(spark):
    words = ["/src/App/Main.py", "./a/b", "/x//y", " a\\b ", "", "a/../b", "../up", "a/./b/", "/", "."]
    want = ["app/main.py", "a/b", "x/y", "a/b", "", "b", "../up", "a/b", ".", "."]
    assert values(spark, words, paths.normalize_path) == want


def test_clean_path_keeps_roots(spark):
    words = ["/", "/.", "//a", "/../a", "./", "a//b/../c", "/a/./", ".hidden", "a/.hidden", "a/..b"]
    want = ["/", "/", "/a", "/a", ".", "a/c", "/a", ".hidden", "a/.hidden", "a/..b"]
    assert values(spark, words, paths.clean_path) == want


def test_test_paths(spark):
    words = ["contest.go", "latest.py", "pkg/tests/a.go", "a_test.go", "test_a.py", "a.spec.ts", "x/conftest.py",
             "src/mock_db.py", "attest/a.py", "a/__mocks__/b.js"]
    want = [False, False, True, True, True, True, True, True, False, True]
    assert values(spark, words, paths.is_test_like) == want


def test_grades(spark):
    got = values(spark, [100, 95, 85, 70, 55, 10], severity.grade, "v int")
    assert got == ["A+", "A", "B", "C", "D", "F"]


def test_vuln_codes(spark):
    words = ["SQL injection here", "server-side template injection", "plain", "JWT in session cookie"]
    assert values(spark, words, severity.vuln_class_code) == ["SQLI", "SSTI", "MISC", "SESSION"]


SPLITS = [
    ("func main() {\n\t// this is a comment\n\tx := 1\n}", "func main() {\n\t\n\tx := 1\n}",
     "             \n // this is a comment\n       \n "),
    ("/*\n multi \n line \n*/\nvar x = 1;", "\nvar x = 1;", "/*\n multi \n line \n*/\n          "),
    ('"""docstring"""\ndef f(): pass', "\ndef f(): pass", '"""docstring"""\n             '),
    ("'''docstring'''\ndef f(): pass", "\ndef f(): pass", "'''docstring'''\n             "),
    ('var s = "string with \\"escape\\"";', 'var s = "";', '        "string with \\"escape\\"" '),
    ('func test() { // comment\n  s := "hello" /* inline */\n}', 'func test() { \n  s := "" \n}',
     '              // comment\n       "hello" /* inline */\n '),
    ("def test():\n    # python comment\n    print('hello')", "def test():\n    \n    print('')",
     "           \n    # python comment\n          'hello' "),
    ("", "", ""),
]


def test_split_code_docs(spark):
    df = spark.createDataFrame([(i, s) for i, (s, _, _) in enumerate(SPLITS)], "i int, content string")
    rows = code_text.split_code_docs(df, compat=True).orderBy("i").collect()
    assert [(r["code"], r["docs"]) for r in rows] == [(c, d) for _, c, d in SPLITS]


def test_split_keeps_line_numbers(spark):
    content = '/* a\n b */ x = "l1\n l2"\n// c\ny = `open\nend'
    df = spark.createDataFrame([(content,)], "content string")
    row = code_text.split_code_docs(df).first()
    assert row["code"].count("\n") == content.count("\n") == row["docs"].count("\n")
    assert row["code"].endswith("y = `\n") and 'x = "\n"' in row["code"]


def test_split_survives_long_strings(spark):
    df = spark.createDataFrame([('x = "' + "a\\n" * 200_000 + '" # ' + "c" * 200_000,)], "content string")
    assert code_text.split_code_docs(df).first()["code"] == 'x = "" '


@pytest.mark.parametrize(
    "findings, positives, score",
    [
        ([("core", "r", "HIGH")], 0, 85), ([("nfr", "r", "HIGH")], 0, 91), ([("core", "r", "MEDIUM")], 0, 95),
        ([("core", "r", "CRITICAL")], 0, 72), ([("core", f"r{i}", "HIGH") for i in range(7)], 0, 32),
        ([("core", "r", "HIGH")], 50, 85), ([("core", "r", "MEDIUM")], 5, 98), ([("core", "r", "LOW")], 50, 100),
    ],
)
def test_health_scores(spark, findings, positives, score):
    df = spark.createDataFrame(
        [("p", s, c, v, "", 0, False) for s, c, v in findings],
        "project string, source string, class string, severity string, file string, line int, ignored boolean",
    )
    good = spark.createDataFrame([("p", positives)], "project string, positives int")
    assert health.health_score(df, ["project"], good).first()["score"] == score


def test_active_duplicate_beats_ignored(spark):
    rows = [("p", "core", "r", "LOW", "a.py", 3, True), ("p", "core", "R ", "HIGH", "A.py", 3, False)]
    df = spark.createDataFrame(
        rows, "project string, source string, class string, severity string, file string, line int, ignored boolean"
    )
    row = health.health_score(df, ["project"]).first()
    assert (row["active_findings"], row["ignored_findings"], row["deduped_findings"], row["score"]) == (1, 0, 1, 85)


def test_policies():
    strict = health.policy_for_profile(" STRICT ")
    assert (strict.fail_on, strict.minimum_score, strict.max_medium) == ("any", 90, 0)
    config = {"strict_mode": True, "fail_score": 40, "health_check": {"max_high": 3, "block_sources": [" Trivy", "trivy"]}}
    p = health.policy_from_config(config)
    assert (p.fail_on, p.minimum_score, p.max_high, p.block_sources) == ("any", 40, 3, ("trivy",))
    assert health.apply_overrides(p, profile="standard", fail_on="never").block_sources == ("trivy",)
    zero = health.normalize_policy(health.Policy("baseline", "odd", 0, 0, 0, 0))
    assert (zero.max_critical, zero.fail_on) == (health.UNLIMITED, "critical")


def test_running_mean(spark):
    rows = [("p", 1, "2024-01-01 00:00:00", 90), ("p", 2, "2024-01-02 00:00:00", 80)]
    df = spark.createDataFrame(rows, "project string, scan_id int, at string, security_score int").select(
        "*", F.col("at").cast("timestamp_ntz").alias("scanned_at")
    )
    got = timeline.running_mean_score(df).orderBy("scan_id").collect()
    assert [r["mean_score"] for r in got] == [90.0, 85.0]


def test_redactions(spark):
    words = ["token = 'abcdefghijkl'", "key AKIA" + "A" * 16 + " end", "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 9]
    want = ["token = [REDACTED]", "key [REDACTED_SECRET] end", "[REDACTED_JWT]"]
    assert values(spark, words, text.redact_secrets) == want
    assert values(spark, ["  sk_live_abcdefgh1234  "], text.redact_preview) == ["sk_l****1234"]


def test_sensitive_values(spark):
    words = ["uses flask-limiter-with-a-long-name-here", "x sk-" + "a" * 24, "-----BEGIN KEY", "", None]
    assert values(spark, words, text.has_sensitive_value) == [False, True, True, False, False]


def test_cache_namespace_is_canonical(spark):
    df = spark.createDataFrame([("m", " "), ("m", "default")], "model string, policy string")
    ns = identity.cache_namespace(F.lit(1), {"model": F.col("model"), "policy": F.col("policy")})
    assert df.select(ns.alias("n")).distinct().count() == 1


# ---- rules ----------------------------------------------------------------

RULES_YAML = """
rules:
  - id: A-1
    name: first
    stack: universal
    extensions: [".py"]
    target: all
    pattern: 'eval\\('
    suggestion: "HIGH: do not"
  - id: A-1
    name: second
    pattern: other
  - id: DOC
    target: entropy-analysis
  - id: FLOW
    mode: taint
  - id: A-2
    pattern: x
    suggestion: "no prefix"
"""


def test_load_rules(tmp_path):
    (tmp_path / "core").mkdir()
    (tmp_path / "core" / "a.yaml").write_text(RULES_YAML)
    (tmp_path / "core" / "b.yaml").write_text("rules: [")
    pack = tmp_path / "pack.json"
    pack.write_text(json.dumps({"rules": [{"id": "A-1", "name": "pack"}, {"id": "P-1", "severity": "LOW"}]}))
    got = catalog.load_rules([tmp_path / "core", pack], custom=[{"id": "C-1", "pattern": "z"}], ignored=["A-2"])
    assert [(r.id, r.name, r.severity, r.suggestion) for r in got] == [
        ("A-1", "first", "HIGH", "do not"), ("P-1", "", "LOW", ""), ("C-1", "", "", ""),
    ]


def scan(spark, files, rule_list, **kw):
    df = spark.createDataFrame([("p", p, c) for p, c in files], "project string, path string, content string")
    rows = rules.scan_rules(df, rule_list, **kw).collect()
    return sorted((r["path"], r["rule_id"], r["line"]) for r in rows)


def test_scan_basics(spark):
    rule = Rule(id="R", extensions=(".py", "Dockerfile"), target="all", pattern=r"eval\(", exclude_tests=True)
    files = [("a.py", "x\neval(1)"), ("a_test.py", "eval(1)"), ("b.js", "eval(1)"), ("d/Dockerfile", "eval("),
             ("c.py", "eval(2) # scan-ignore: R"), ("d.py", "# scan-ignore-next-line: all\neval(2)"),
             ("e.py", "# scan:ignore-file\n\n\neval(2)")]
    assert scan(spark, files, [rule]) == [("a.py", "R", 2), ("d/Dockerfile", "R", 1)]


def test_dialect(spark):
    files = [("a.py", "abc\n"), ("b.py", "abc"), ("c.py", "a\rb")]
    assert scan(spark, files, [Rule(id="E", extensions=(".py",), target="all", pattern="abc$")]) == [("b.py", "E", 1)]
    assert scan(spark, files, [Rule(id="D", extensions=(".py",), target="all", pattern="a.b")]) == [("c.py", "D", 1)]
    look = Rule(id="L", extensions=(".py",), target="all", pattern=r"ADD\s+(?!https)")
    add = [("x.py", "ADD ./a"), ("y.py", "ADD https://b"), ("z.py", r"ADD\s+(?!https)")]
    assert scan(spark, add, [look]) == [("x.py", "L", 1)]
    assert scan(spark, add, [look], compat=True) == [("z.py", "L", 1)]


def test_conditions(spark):
    share = Rule(id="S", extensions=(".py",), target="lines_percentage", pattern="bad", condition="threshold:0.4")
    big = Rule(id="G", extensions=(".py",), target="condition", condition="large_file")
    files = [("a.py", "bad\nbad\nok"), ("b.py", "bad\nok\nok"), ("c.py", "\n" * 1501)]
    assert scan(spark, files, [share, big]) == [("a.py", "S", 1), ("c.py", "G", 1)]


def test_stack_gate(spark):
    df = spark.createDataFrame(
        [("p", "a.py", "eval(", "flask"), ("p", "b.py", "eval(", "django")],
        "project string, path string, content string, stack string",
    )
    rule = Rule(id="R", stack="flask", extensions=(".py",), target="all", pattern=r"eval\(")
    assert [r["path"] for r in rules.scan_rules(df, [rule]).collect()] == ["a.py"]


def test_required_pattern_needs_a_file(spark):
    rule = Rule(id="Q", extensions=("Dockerfile",), target="all", pattern="USER", condition="required_pattern")
    df = spark.createDataFrame(
        [("has", "Dockerfile", "USER x"), ("lacks", "Dockerfile", "RUN x"), ("none", "a.py", "")],
        "project string, path string, content string",
    )
    assert [r["project"] for r in rules.required_pattern(df, [rule]).collect()] == ["lacks"]


def test_nfr_gate(spark):
    rule = NfrRule("N", "limit", "HIGH", "file_contains", "limit", ("*.py",), r"FastAPI\(", ("*.py",))
    df = spark.createDataFrame(
        [("web", "a.py", "FastAPI()"), ("safe", "a.py", "FastAPI() limit"), ("lib", "a.py", "x"),
         ("vend", "vendor/a.py", "FastAPI()")],
        "project string, path string, content string",
    )
    got = rules.nfr_rules(df, df.select("project"), [rule]).collect()
    assert [r["project"] for r in got] == ["web"]


def test_secret_patterns(spark):
    samples = {
        "AWS Access Key": "AKIA" + "B" * 16, "GitLab Token": "glpat-" + "a" * 20,
        "Slack Token": "xoxb-1234567890-1234567890-" + "a" * 24, "Google API Key": "AIza" + "c" * 35,
        "Private Key": "-----BEGIN RSA PRIVATE KEY-----", "SendGrid Key": "SG." + "a" * 22 + "." + "b" * 43,
        "Stripe Key": "sk_live_" + "d" * 24, "GitHub Token": "ghs_" + "e" * 36,
        "Generic Secret": "Password: 'longenough'", "Generic API Key": "api-key=" + "f" * 20,
        "JWT Token": "eyJ" + "a" * 10 + ".eyJ" + "b" * 10 + "." + "c" * 10,
        "AWS Secret Key": "aws_secret_access_key = " + "g" * 40,
    }
    df = spark.createDataFrame(
        [("p", name, f"first\n{line}\nlast") for name, line in samples.items()],
        "project string, path string, content string",
    )
    rows = file_checks.secret_scan(df).collect()
    assert {r["path"]: (r["pattern"], r["line"]) for r in rows} == {n: (n, 2) for n in samples}


# ---- sources --------------------------------------------------------------


def test_read_corpus(spark, tmp_path):
    tree = {
        "app/src/a.py": b"print(1)", "app/node_modules/x.js": b"no", "app/logo.png": b"no", "app/v.min.js": b"no",
        "app/bin.dat": b"a\x00b", "app/r.md": b"<!-- generated-report -->", "app/ok.md": b"text",
        "lib/skip/me.py": b"no", "lib/e.py": "é".encode(),
    }
    for name, data in tree.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    rows = corpus.read_corpus(spark, str(tmp_path), ignore_paths=("skip/",)).collect()
    assert sorted((r["project"], r["path"], r["content"]) for r in rows) == [
        ("app", "ok.md", "text"), ("app", "src/a.py", "print(1)"), ("lib", "e.py", "é"),
    ]
    left_out = corpus.skipped_files(corpus.read_tree(spark, str(tmp_path)), ignore_paths=("skip/",)).collect()
    assert sorted((r["path"], r["skipped"]) for r in left_out) == [
        ("bin.dat", "binary"), ("logo.png", "ignored kind"), ("node_modules/x.js", "ignored folder"), ("r.md", "report"),
        ("skip/me.py", "excluded"), ("v.min.js", "bundle"),
    ]


def test_scan_history(spark, tmp_path):
    for day, rule in (("2024-01-01", "OLD"), ("2024-01-02", "NEW")):
        doc = {"timestamp": f"{day}T00:00:00Z", "project_path": "/p",
               "report": {"security_score": 1, "results": [{"id": rule, "file": "a", "line": 1}]}}
        (tmp_path / f"{day}.json").write_text(json.dumps(doc, indent=2))
    history = stores.read_scan_history(spark, str(tmp_path))
    assert [r["rule_id"] for r in stores.latest_scan_results(history).collect()] == ["NEW"]


def test_store_defaults(spark, tmp_path):
    rows = spark.createDataFrame([(1, None, 7)], "id long, lifecycle string, sla_high int")
    rows.write.parquet(str(tmp_path / "products"))
    row = stores.read_findings_store(spark, str(tmp_path), ["products"])["products"].first()
    assert (row["lifecycle"], row["sla_high"], row["sla_critical"], row["sla_low"]) == ("production", 7, 1, 90)
