"""Ids that stand on rows with different texts."""

import random

from ambersift.llm import jaccard_join

from .conftest import frame, sentence


def test_only_the_near_copy_of_an_id_goes(spark):
    rng = random.Random(2)
    base, clean = sentence(rng, 200), sentence(rng, 200)
    rows = [(1, base), (2, f"{base} end"), (2, clean), (2, None), (3, f"{clean} end"), (None, base)]
    kept = jaccard_join.drop_near_copies(frame(spark, rows))
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == sorted([(0, base), (1, base), (2, clean), (2, "")])
