"""Texts that views make are made once, wherever hits are looked for in them."""

from pyspark.sql import functions as F

from ambersift.functions.paths import relative_uri
from ambersift.operators import file_checks, rules
from ambersift.operators.roots import detect_stack
from ambersift.operators.rules import Rule
from ambersift.operators.scan import file_facts
from ambersift.operators.unroll import unrolled
from ambersift.session import slice_count


def made(spark):
    """Files whose text is a costly expression, marked by ``md5``."""
    text = F.concat(F.lit("password = 'xK9#"), F.md5(F.col("id").cast("string").cast("binary")), F.lit("'\neval(x)\n"))
    return spark.range(40).select(
        F.lit("p").alias("project"), F.concat(F.lit("a"), F.col("id"), F.lit(".py")).alias("path"), text.alias("content")
    )


def mentions(df, what):
    return df._jdf.queryExecution().optimizedPlan().toString().count(what)


def test_rows_of_arrays(spark):
    rows = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None)], "k int, xs array<string>")
    got = unrolled(rows, ["k"], "xs", "x").collect()
    assert sorted((r.k, r.x) for r in got) == [(1, "a"), (1, "b")]


def test_rules_do_not_make_texts_again(spark):
    either = Rule(id="R", extensions=(".py",), pattern_either=(
        Rule(id="", target="all", pattern=r"eval\("), Rule(id="", target="all", pattern="password")))
    out = rules.scan_rules(made(spark), [either])
    assert mentions(out, "md5(") == 1
    assert out.count() == 40


def test_secrets_do_not_make_texts_again(spark):
    for directive in (None, "scan"):
        out = file_checks.secret_assignments(made(spark), directive)
        assert mentions(out, "md5(") == 1
        assert out.count() > 30
    assert mentions(file_checks.secret_scan(made(spark)), "md5(") == 1


def test_large_files_do_not_make_texts_again(spark):
    out = file_checks.large_files(made(spark), 1)
    assert mentions(out, "md5(") == 1
    assert {r.newlines for r in out.collect()} == {2}


def test_a_single_row_group_becomes_many_slices(spark, tables):
    assert tables.code_files.rdd.getNumPartitions() >= slice_count(spark)


def test_relative_paths_are_split_once(spark):
    rows = spark.createDataFrame(
        [("/srv/app/a/b.py",), ("/srv/other/./x.py",), ("\\opt\\y.py",), ("c/d.py",), ("/srv/app",), (None,), ("",), ("/",)], "file string"
    )
    out = rows.select(relative_uri(F.col("file"), "/srv/app/").alias("uri"))
    assert mentions(out, "split(") <= 3
    assert [r.uri for r in out.collect()] == ["a/b.py", "../other/x.py", "../../opt/y.py", "c/d.py", ".", None, "", "../.."]


def test_customers_are_read_once_and_dealt_out(spark, tables):
    rows = tables.project_files
    assert mentions(rows, "Relation [") == 1
    assert rows.rdd.getNumPartitions() >= slice_count(spark)


def test_a_line_is_searched_once_for_name_and_value(spark):
    shape = file_checks.ASSIGNMENT[4:30]
    for directive in (None, "scan"):
        assert mentions(file_checks.secret_assignments(made(spark), directive), shape) == 1
    facts = file_facts(made(spark), [])
    assert mentions(facts, "****$2") == 0  # no previews where only lines are asked for
    assert {(h.rule_id, h.line) for r in facts.collect() for h in r.hits} == {("ENTROPY-SECRET", 1)}


def test_the_single_search_finds_the_first_assignment(spark):
    lines = [
        "password = 'abcdefgh'", "x = 1; my_token2 := \"12345678\" # api_key='second-value'", "token token = 'abcdefgh'", "secret",
        "password = 'short' and apikey: 'long enough'", "PASSWORDS\t:'12345678'", "no-secret='a\rbcdefgh'", "ütoken='abcdefgh'", "", "a.secret ='\"abcdefg'",
        "tokentokentoken tokenx_='abcdefgh'", "secret==\"abcdefgh\"", "api_keyapikey = = 'abcdefgh'",
    ]
    t = spark.createDataFrame([(s,) for s in lines], "t string")
    pair = F.regexp_replace("t", file_checks.ASSIGNED, "$1\n$2")
    one = [F.when(F.contains(pair, F.lit("\n")), F.substring_index(pair, "\n", n)).otherwise("") for n in (1, -1)]
    got = t.select(*one, *[F.regexp_extract("t", file_checks.ASSIGNMENT, i) for i in (1, 2)]).collect()
    assert all(tuple(r)[:2] == tuple(r)[2:] for r in got)
    assert sum(r[0] != "" for r in got) >= 8


def test_required_patterns_by_root_do_not_make_texts_again(spark):
    rule = Rule(id="R", extensions=(".py",), target="all", pattern="absent", condition="required_pattern")
    roots = spark.createDataFrame([("p", ".", "unknown")], "project string, root string, stack string")
    out = rules.required_pattern(made(spark), [rule], roots)
    assert mentions(out, "md5(") == 0  # flags are written
    assert [(r.project, r.root, r.rule_id) for r in out.collect()] == [("p", ".", "R")]
    assert mentions(detect_stack(made(spark)), "md5(") == 0
