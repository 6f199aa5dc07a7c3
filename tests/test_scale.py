"""Hot keys, order independence and exactness against brute force."""

import json
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from ambersift.operators import compare, file_checks, merge, naming, ordering, timeline, triage
from ambersift.session import bucketed, written
from ambersift.sources import reports
from ambersift.streaming import changes
from conftest import SF


@pytest.fixture(scope="module")
def hot(spark):
    """30,000 rows of which a third belong to one group."""
    g = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500)
    return spark.range(30_000).select(g.alias("g"), F.xxhash64("id").alias("k"), "id", (F.col("id") % 11).alias("v"))


def same(a, b):
    assert a.count() == b.count()
    assert a.exceptAll(b).isEmpty()


def test_rank_in_hot_group(hot):
    got = ordering.rank_within(hot, ["g"], [F.col("k")], "n")
    want = hot.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("k")).cast("long"))
    same(got.select("g", "k", "id", "v", "n"), want)


def test_rank_without_group(hot):
    got = ordering.rank_within(hot, [], [F.col("k")], "n").agg(F.min("n"), F.max("n"), F.countDistinct("n")).first()
    assert tuple(got) == (1, 30_000, 30_000)


def test_running_and_lag_in_hot_group(hot):
    w = Window.partitionBy("g").orderBy("k")
    got = ordering.running_within(hot, ["g"], [F.col("k")], F.col("v"), "s", "c").select("id", "s", "c")
    same(got, hot.select("id", F.sum("v").over(w).alias("s"), F.count("v").over(w).alias("c")))
    got = ordering.lag_within(hot, ["g"], [F.col("k")], F.col("v"), "p").select("id", "p")
    same(got, hot.select("id", F.lag("v").over(w).alias("p")))


def test_slices_split_the_hot_group(hot):
    rows = ordering.ordered_slices(hot, ["g"], [F.col("k")])
    sizes = [r["count"] for r in rows.groupBy("_slice").count().collect()]
    assert len(sizes) > 4 and max(sizes) < 30_000 / 3
    assert rows.filter("g = 0").select("_slice").distinct().count() > 1


def test_null_groups_are_ranked(spark):
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "g string, k int")
    rows = ordering.rank_within(df, ["g"], [F.col("k")], "n").collect()
    assert sorted((r["k"], r["n"]) for r in rows) == [(1, 1), (2, 2), (3, 1)]


def test_numbering_ignores_input_order(tables):
    base = tables.enriched.drop("vuln_id")
    first = merge.canonical_vuln_ids(base, tie=["idx"]).select("idx", "vuln_id")
    again = merge.canonical_vuln_ids(base.orderBy(F.rand(3)).repartition(5), tie=["idx"]).select("idx", "vuln_id")
    same(first, again)


def test_findings_elsewhere_leave_ids_alone(tables):
    base = tables.enriched.drop("vuln_id")
    name = base.groupBy("project").count().orderBy(F.desc("count"), "project").first()["project"]
    own = base.filter(F.col("project") == name)
    first, again = (
        merge.canonical_vuln_ids(d, ["project"], tie=["idx"]).filter(F.col("project") == name).select("idx", "vuln_id")
        for d in (own, base)
    )
    same(first, again)
    assert first.count() > 1


def test_no_finding_is_lost_in_groups(tables):
    rows = merge.dedup_exact(tables.enriched, "idx", ["project"])
    n = tables.enriched.count()
    assert rows.count() == n == rows.filter("is_first").agg(F.sum("group_size")).first()[0]
    merged = merge.dedup_semantic(tables.raw_findings, ["product_id"])
    assert merged.agg(F.sum("merged")).first()[0] == tables.raw_findings.count()


def test_every_finding_gets_one_verdict(tables):
    unique = merge.unique_findings(tables.enriched, "idx", ["project"]).select("project", "fingerprint", "idx")
    verdicts = unique.withColumn("disposition", F.lit(triage.TRUE_POSITIVE)).drop("idx")
    back = merge.project_verdicts(tables.enriched, verdicts, ["project"]).select("idx", "disposition")
    assert triage.incomplete_findings(tables.enriched, back).isEmpty()


def test_incomplete_artifact_fails(tables):
    short = tables.verdicts.filter("idx > 0")
    with pytest.raises(Exception, match="exactly one verdict"):
        triage.triage_artifact(tables.inventory.select("idx", "file"), short).collect()


NAMES = ["redis", "nginx", "post", "gres", "x", "long name"]
TEXTS = ["uses postgres and redis", "xx", "", "a long name here", "nothing"]


def test_names_in_texts(spark):
    """More names than any list in a plan should hold, and names shorter than a piece."""
    many = [f"package name {i}" for i in range(700)] + NAMES + ["", None]
    told = TEXTS + [f"see package name {i} twice: package name {i + 1}!" for i in range(0, 700, 9)] + [None]
    texts = spark.createDataFrame([(k, t) for t in told for k in (1, 2)], "g int, text string")
    names = spark.createDataFrame([(1, n) for n in many], "g int, name string")
    got = [tuple(r) for r in naming.texts_naming(texts, names, ["g"]).collect()]
    want = {(1, t, n) for t in told for n in many if t and n and n in t}
    assert len(got) == len(want) and set(got) == want


def test_ten_thousand_names_against_brute_force(spark):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeé-_. ") for _ in range(rng.randint(1, 12)))
    names = sorted({word() for _ in range(12_000)})[:10_000]
    told = ["".join(rng.choice("abcdeé-_. xyz") for _ in range(rng.randint(0, 300))) for _ in range(150)]
    told += [told[0]] * 40 + [" ".join(rng.sample(names, 30)) for _ in range(30)] + ["x" * 20_000]
    texts = spark.createDataFrame([(t,) for t in told], "text string")
    got = [tuple(r) for r in naming.texts_naming(texts, spark.createDataFrame([(n,) for n in names], "name string")).collect()]
    want = {(t, n) for t in told for n in names if n in t}
    assert len(got) == len(want) > 10_000 and set(got) == want


def test_texts_leave_the_scan_as_few_pieces(spark):
    """Of a text of a thousand characters only pieces that names chose are sent, without the text."""
    rng = random.Random(12)
    letters = [chr(c) for c in range(97, 123)] + list("0123456789")
    texts = naming.distinct_texts(
        spark.createDataFrame([("".join(rng.choice(letters) for _ in range(1000)) + " nginx",) for _ in range(200)], "text string"), []
    )
    names = spark.createDataFrame([(n,) for n in ("nginx", "postgres", "redis", "kafka broker", "vault")], "name string")
    sent = naming.postings(texts, naming.pieces_of_names(names, []), [])
    assert sent.columns == ["tid", "piece"]
    assert 200 <= sent.count() <= 260
    assert {r["name"] for r in naming.names_in(texts, names).collect()} == {"nginx"}


def test_rescan_is_one_join(spark):
    s = spark.createDataFrame([(1, "A", "t", "a.py")], "id int, rule_id string, title string, file_path string")
    r = spark.createDataFrame([("core", "A", "t", "a.py")], "type string, rule_id string, title string, file string")
    plan = compare.still_present(s, r)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") < 15


def test_results_leave_other_findings_alone(tables):
    none = tables.orders.limit(0)
    results = none.selectExpr("o_orderkey AS id", "true AS fixed", "'s' AS summary")
    verdicts = none.selectExpr("o_orderkey AS id", "'true_positive' AS verdict", "'s' AS summary")
    for out in (compare.apply_verification(tables.findings, results, F.current_timestamp()),
                compare.apply_triage(tables.findings, verdicts)):
        same(out.select(*tables.findings.columns), tables.findings)


def brute_still_present(stored, rescan):
    out = set()
    for sid, rule, title, file in stored:
        for kind, r_rule, r_title, r_file in rescan:
            t, rt = title.strip().lower(), r_title.strip().lower()
            place = (
                not file or (r_file != "" and (file == r_file or file.endswith("/" + r_file) or r_file.endswith("/" + file)))
            )
            hit = {
                "core": place and (rule == r_rule or (t and t == rt)),
                "external": place and (rule == r_rule or (t and t in rt)),
                "nfr": rule == r_rule or (t and t == rt),
                "deploy": rule == r_rule or (place and t and t == rt),
                "network": rule == r_rule or rt in t,
                "leak": place and rule.startswith("gitleak-"),
            }[kind]
            if hit:
                out.add(sid)
    return out


def test_still_present_matches_brute_force(spark):
    rnd = random.Random(7)
    rules, titles = ["A", "B", "gitleak-1", "net-h-1"], ["Open port on db", "Eval used", "XSS", ""]
    files = ["", "a.py", "src/a.py", "x/src/a.py", "rc/a.py", "b/a.py"]
    stored = [(i, rnd.choice(rules), rnd.choice(titles), rnd.choice(files)) for i in range(120)]
    kinds = ["core", "external", "nfr", "deploy", "network", "leak"]
    for _ in range(3):
        rescan = [
            (k := rnd.choice(kinds), rnd.choice(["A", "C", "net-h-1"]),
             "db" if k == "network" else rnd.choice(["eval used", "some XSS found", "other"]), rnd.choice(files))
            for _ in range(4)
        ]
        s = spark.createDataFrame(stored, "id int, rule_id string, title string, file_path string")
        r = spark.createDataFrame(rescan, "type string, rule_id string, title string, file string")
        got = {row["id"] for row in compare.still_present(s, r).collect()}
        assert got == brute_still_present(stored, rescan), rescan


def test_debounce_matches_brute_force(spark):
    rnd = random.Random(5)
    rows = [(i, "w" if rnd.random() < 0.4 else f"w{i % 9}", f"d/f{rnd.randrange(6)}.py", rnd.randrange(400_000))
            for i in range(4000)]
    at = F.timestamp_add("MICROSECOND", F.col("ms") * 1000, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    events = spark.createDataFrame(rows, "event_id int, workspace string, path string, ms long").select(
        "event_id", "workspace", "path", F.lit("write").alias("op"), at.alias("changed_at")
    )
    got = changes.debounced_changes_batch(events, 0.3).groupBy("workspace", "started_at").agg(
        F.sum("events").alias("n")
    ).collect()
    want, last, start = {}, {}, {}
    for _, ws, _, ms in sorted(rows, key=lambda r: (r[1], r[3], r[0])):
        if ws not in last or ms - last[ws] >= 300:
            start[ws] = ms
        last[ws] = ms
        want[ws, start[ws]] = want.get((ws, start[ws]), 0) + 1
    assert sorted(r["n"] for r in got) == sorted(want.values()) and len(got) == len(want)


def test_digest_sees_order_and_content(spark):
    a = spark.range(10_000).select(F.lit("r").alias("run"), "id", (F.col("id") % 7).cast("string").alias("v"))
    b = a.withColumn("v", F.when(F.col("id") == 9_000, "x").otherwise(F.col("v")))

    def digest(df):
        return triage.ordered_digest(df, ["run"], "id", F.col("v"), chunk=100).first()

    assert digest(a)["entries"] == 10_000
    assert digest(a)["digest"] == digest(a.repartition(7))["digest"] != digest(b)["digest"]


def test_tree_digest_sees_any_change(spark):
    a = spark.createDataFrame([("p", f"f{i}", "x") for i in range(300)], "project string, path string, content string")
    b = a.withColumn("content", F.when(F.col("path") == "f7", "y").otherwise(F.col("content")))
    first, second = (timeline.tree_fingerprint(d).first() for d in (a, b))
    assert first["files"] == 300 and first["digest"] != second["digest"]


def test_closure_survives_cycles_and_depth(spark):
    edges = spark.createDataFrame(
        [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e")], "parent string, child string"
    )
    roots = spark.createDataFrame([("a",)], "node string")
    got = {r["node"]: r["depth"] for r in timeline.dep_closure(edges, roots).collect()}
    assert got == {"a": 0, "b": 1, "c": 2, "d": 3, "e": 4}
    deep = spark.range(45).selectExpr("CAST(id % 2 AS STRING) AS project", "CAST(id AS STRING) AS parent", "CAST(id + 2 AS STRING) AS child")
    got = timeline.dep_closure(deep, timeline.dep_roots(deep, ["project"]), ["project"]).groupBy("project").agg(F.max("depth").alias("d"))
    assert {r["project"]: r["d"] for r in got.collect()} == {"0": 23, "1": 22}


def test_closure_moves_neither_edges_nor_packages_found(spark):
    """Both tables of a round lie in buckets of the join keys, also after a second round is appended."""
    edges = spark.range(400).selectExpr("CAST(id % 3 AS STRING) AS project", "CAST(id AS STRING) AS parent", "CAST(id * 7 % 400 AS STRING) AS child")
    links = bucketed(edges, ["project", "parent"], "links_test", 8)
    nodes = edges.selectExpr("project", "parent AS node", "0 AS depth")
    bucketed(nodes.filter("node < '2'"), ["project", "node"], "nodes_test", 8)
    seen = bucketed(nodes.filter("node >= '2'"), ["project", "node"], "nodes_test", 8)
    assert seen.count() == 400
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        step = links.join(seen.select("project", F.col("node").alias("parent")), ["project", "parent"], "left_semi")
        assert "Exchange" not in step._jdf.queryExecution().executedPlan().toString() and step.count() == 400
        fresh = nodes.groupBy("project", "node").agg(F.min("depth").alias("depth")).join(seen, ["project", "node"], "left_anti")
        assert fresh._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        for name in ("links_test", "nodes_test"):
            spark.sql(f"DROP TABLE {name}")


@pytest.mark.parametrize("hops", [1, 2, 5])
def test_closure_against_breadth_first_search(spark, hops):
    rng = random.Random(hops)
    pairs = {(rng.choice("pq"), str(rng.randrange(60)), str(rng.randrange(60))) for _ in range(130)}
    roots = {("p", "0"), ("p", "1"), ("q", "2"), ("q", "none")}
    want, level, front = {r: 0 for r in roots}, 0, roots
    while front:
        level += 1
        front = {(g, c) for g, p, c in pairs if (g, p) in front} - set(want)
        want |= {n: level for n in front}
    edges = spark.createDataFrame(sorted(pairs) * 2, "project string, parent string, child string")
    got = timeline.dep_closure(edges, spark.createDataFrame(sorted(roots), "project string, node string"), ["project"], hops).collect()
    assert len(got) == len(want) and {(r["project"], r["node"]): r["depth"] for r in got} == want


def test_every_package_has_one_entry(spark):
    edges = spark.createDataFrame([("p", "hub", f"c{i % 40}") for i in range(50)], "project string, parent string, child string")
    deps = spark.createDataFrame([("p", "n", "1", "dev", "npm")], "project string, name string, version string, type string, ecosystem string")
    rows = reports.to_sbom(deps, edges).filter("section = 'dependencies'")
    parsed = rows.select(F.from_json("value", "ref string, dependsOn array<string>").alias("d")).select("d.*").collect()
    assert [(r["ref"], r["dependsOn"]) for r in parsed] == [("hub", sorted(f"c{i}" for i in range(40)))]


def test_context_window_edges(spark):
    files = spark.createDataFrame([("p", "a.py", "import x\nl2\nl3")], "project string, path string, content string")
    places = spark.createDataFrame([("p", "a.py", n) for n in (0, 1, 3, 9, None)], "project string, path string, line int")
    rows = {r["line"]: r for r in file_checks.context_window(places, files, radius=1, fallback=2).collect()}
    assert sorted(rows) == [0, 1, 3, 9]
    assert rows[0]["snippet"] == rows[9]["snippet"] == "import x\nl2" and rows[9]["end_line"] == 2
    assert rows[3]["snippet"] == "   2: l2\n>> 3: l3" and rows[1]["imports"] == "import x"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_top_k_is_cut_before_the_shuffle(tables):
    from ambersift.operators import dashboard

    assert "WindowGroupLimit" in plan_of(dashboard.top_per_product(tables.findings))
    assert "WindowGroupLimit" in plan_of(timeline.last_n_scans(tables.scan_metrics))


def test_rule_scan_never_shuffles_content(tables):
    from ambersift.operators.rules import scan_rules
    from ambersift.plans.corpus_q import SIGNAL_RULES

    files = tables.documents.select(F.col("source").alias("project"), F.lit("a.py").alias("path"), F.col("text").alias("content"))
    plan = plan_of(scan_rules(files, SIGNAL_RULES))
    assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_filters_reach_the_scan(tables):
    from ambersift.operators import dashboard

    plan = plan_of(tables.events.filter("event_type = 'error'").select("user_id"))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,error)]" in plan
    plan = plan_of(dashboard.open_by_severity(tables.findings))
    assert "props" not in plan.split("ReadSchema")[1]


def test_catalog_of_two_hundred_rules(spark, tables):
    from ambersift.operators.rules import Rule, scan_rules

    targets = ("all", "code", "docs")
    many = [
        Rule(id=f"R{i}", extensions=(".py", ".js"), target=targets[i % 3], pattern=rf"(?i)word{i}\b|total = \d*{i}\d*",
             condition="not_contains:never" if i % 5 else "", severity="LOW")
        for i in range(200)
    ]
    rows = scan_rules(tables.code_files, many)
    per_rule = rows.groupBy("rule_id").count().count()
    want = tables.code_files.filter(F.rlike("path", F.lit(r"\.(py|js)\z"))).filter(
        F.rlike("content", F.lit("(?i)total = ")) & ~F.contains("content", F.lit("scan-ignore-file"))
    )
    assert per_rule > 50 and rows.select("path").distinct().count() <= want.count()


def test_cited_files_are_kept_and_others_stay_in_place(spark):
    from ambersift.operators.citations import cited_only

    files = spark.range(3000).selectExpr("concat('p', id % 7) AS project", "concat('f', id) AS path", "repeat('x', 50) AS content")
    keys = files.filter("path LIKE '%00'").select("project", "path")
    keys = keys.unionByName(spark.createDataFrame([(None, "f1"), ("p9", "nowhere")], "project string, path string"))
    kept = cited_only(files, keys, ["project", "path"])
    assert kept.columns == files.columns
    same(kept.join(keys, ["project", "path"], "left_semi"), files.join(keys, ["project", "path"], "left_semi"))
    assert kept.count() <= 30 + 5


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_texts_move_only_if_cited(spark, tables, no_broadcast):
    """Below every exchange that carries content, uncited files have been dropped already."""
    from ambersift.operators import remedy

    files = tables.documents.select(F.col("source").alias("project"), F.lit("a.py").alias("path"), F.col("text").alias("content"))
    places = spark.createDataFrame([("src0", "a.py", 3, "R")], "project string, path string, line int, rule_id string")
    plans = [
        file_checks.context_window(places, files), file_checks.changed_files_only(files, places),
        remedy.suggest_fix(places, files),
    ]
    for df in plans:
        lines = plan_of(df).splitlines()
        depth = [len(x) - len(x.lstrip(" :+-")) for x in lines]
        checked = 0
        for k, line in enumerate(lines):
            if "Exchange hashpartitioning" not in line:
                continue
            end = next((j for j in range(k + 1, len(lines)) if depth[j] <= depth[k]), len(lines))
            below = lines[k + 1 : end]
            if any("FileScan" in x and "text#" in x for x in below):
                checked += 1
                assert any("BroadcastHashJoin" in x for x in below), "\n".join(lines)
        assert checked


def test_absolute_evidence_below_the_project_root(spark):
    files = spark.createDataFrame([("p", "src/a.py", "one\ntwo api_key\n")], "project string, path string, content string")
    findings = spark.createDataFrame(
        [(1, "V1", "f", "p", "/workspace/src/a.py", 2)], "idx long, vuln_id string, fingerprint string, project string, file string, line int"
    )
    verdicts = spark.createDataFrame(
        [(1, n, "V1", "f", triage.FALSE_POSITIVE, "code_mitigation", path, 2, "api_key")
         for n, path in enumerate(["/workspace/src/a.py", "src/a.py", "/elsewhere/src/a.py"])],
        "idx long, seq long, finding_id string, v_fingerprint string, disposition string, basis string, ev_file string, ev_line int, observed string",
    )
    got = {r["seq"]: r["reason"] for r in triage.validate_fp_evidence(verdicts, findings, files, root="/workspace").collect()}
    assert got == {0: "", 1: "", 2: "code_bad_file"}


def test_documents_are_json(tables):
    for parts in (reports.sarif_document(tables.audited, "t", "1"), reports.sbom_document(tables.deps, tables.dep_edges, "urn:x:")):
        held = {}
        for r in sorted(parts.collect(), key=lambda r: (r["section"], r["place"])):
            held.setdefault(r["project"], []).append(r["value"])
        docs = [json.loads("".join(v)) for v in held.values()]
        assert docs and any(d.get("components") or d["runs"][0]["results"] for d in docs)


def test_names_are_not_broadcast(spark, monkeypatch):
    """The small file of the names says little of their size once they are salted."""
    plans = []

    def keep(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df)

    monkeypatch.setattr(naming, "written", keep)
    texts = naming.distinct_texts(spark.createDataFrame([(1, "about nginx here")], "k int, text string"), ["k"])
    names = spark.createDataFrame([(1, "nginx")], "k int, name string")
    found = naming.names_in(texts, names, ["k"])
    # One broadcast only: that of the bit table.
    assert "SortMergeJoin" in plans[-1] and plans[-1].count("BroadcastHashJoin") == 1
    assert [r["name"] for r in found.collect()] == ["nginx"]


def test_git_stats_by_many_tasks(spark, monkeypatch):
    """Rows are counted in place by as many tasks as they ask for; two distinct counts in one aggregate trebled them."""
    monkeypatch.setattr(timeline, "STAT_ROWS", 20)
    draw = random.Random(6)
    rows = [
        (draw.choice(["p", "q", None]), draw.choice([*range(6), None]), draw.choice(["a", "b", None]), draw.choice(["f", "g"]),
         draw.choice([700, 1, None]), draw.choice([3, None]), i)
        for i in range(600)
    ]
    stat = spark.createDataFrame(
        rows, "project string, commit_id long, author_email string, file_path string, additions long, deletions long, committed_at long"
    )
    got = timeline.git_file_stats(stat, ["project"])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand [" not in plan and plan.count("RepartitionByExpression") == 2 and plan.count(", 31\n") == 2
    per = stat.groupBy("project", "file_path", "commit_id", "author_email").agg(
        F.sum("additions").alias("a"), F.sum("deletions").alias("d"), F.max("committed_at").alias("at")
    )
    want = per.groupBy("project", "file_path").agg(
        F.countDistinct("commit_id").alias("commits"), F.countDistinct("author_email").alias("authors"),
        F.sum("a").alias("additions"), F.sum(F.col("a") + F.col("d")).alias("lines_changed"), F.max("at").alias("last_modified"),
    )
    same(got.drop("agentic_score"), want)
    # A project's whole history may be one file of one commit.
    assert [tuple(r)[1:4] for r in timeline.git_file_stats(stat.filter("false")).collect()] == []


def test_scan_keys_move_with_shown_columns_only(spark):
    """Names, evidence and suggestions went through the shuffle of every row."""
    from __spark_entry__ import queries

    plan = queries()["dedup_scan"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "seen in" not in plan and "Fix step" not in plan and "scan_key" in plan


def test_bill_of_materials_works_deps_out_once(spark, tmp_path):
    """Project names come from the written slices; before, ``deps`` was worked out again for them."""
    rows = [("p", "a", "1", "dev", "npm"), ("q", "b", "2", "prod", "go"), (None, "c", "3", "prod", "go")]
    spark.createDataFrame(rows, "project string, name string, version string, type string, ecosystem string").write.parquet(f"{tmp_path}/deps")
    edges = spark.createDataFrame([("p", "a", "z"), ("other", "a", "z")], "project string, parent string, child string")
    parts = reports.sbom_document(spark.read.parquet(f"{tmp_path}/deps"), edges, "urn:x:")
    assert not [f for f in parts.inputFiles() if str(tmp_path / "deps") in f]
    held = sorted((r.project, r.section, r.place) for r in parts.collect() if r.project)
    assert held == sorted([(p, s, 1) for p in "pq" for s in (0, 1, 2, 4)] + [("p", 3, 1)])


def test_ranked_rows_are_not_shuffled_again(hot):
    """The table of slices is small, which a plan over the rows it was counted from does not know."""
    plan = ordering.rank_within(hot, ["g"], [F.col("k")], "n")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
