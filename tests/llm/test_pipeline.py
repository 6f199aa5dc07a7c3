"""The pipeline stage by stage against brute force."""

import re

from conftest import SF

import corpus_pipeline
from __spark_entry__ import queries

from .oracle import PLAIN, infix_edits, near_groups


def test_stages_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == columns
        kept.append(docs.toPandas())
    clean = dict(zip(kept[0].doc_id, kept[0].text))
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert sum(labels.get(i) == 0 for i in clean) >= 0.97 * sum(y == 0 for y in labels.values())

    first = {}
    for i in sorted(clean, key=lambda i: (-len(clean[i]), i)):
        first.setdefault(re.sub(r"[\x20\x09-\x0D]", "", clean[i]), i)
    assert sorted(kept[1].doc_id) == sorted(first.values())

    one = dict(zip(kept[1].doc_id, kept[1].text))
    assert sorted(kept[2].doc_id) == sorted(i for i, (group, _, _) in near_groups(one).items() if group == i)

    items = [PLAIN.findall(r.text.lower()) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for i, t in zip(kept[2].doc_id, kept[2].text):
        w = PLAIN.findall(t.lower())
        seen = set(w)
        near = [x for x in items if sum(y in seen for y in x) >= 0.8 * len(x)]
        leaks = any(infix_edits(x, w) <= int(0.2 * len(x) + 1e-9) for x in near)
        assert (i in set(kept[3].doc_id)) != leaks, i

    plan = kept[4]
    assert set(plan.doc_id) == set(kept[3].doc_id)
    assert plan.groupby("sequence_id").length.sum().max() <= 2048


def test_run_gives_the_plan(spark):
    out = queries()["pipeline"](spark, SF)
    assert {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} == set(out.columns) and out.count()


def test_stages_on_empty_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
