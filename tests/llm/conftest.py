import random

import pytest
from pyspark.sql import functions as F

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    # Names that operators use inside: they must not get in the way.
    "id long, n long, key string, uid long, variant int, logit double, near_id long, leak_id long, own_sha string, kept boolean"
)
EXTRA = (7, 7, "x", 7, 7, 7.0, 7, 7, "x", False)
SYLLABLES = "an er on re the in st nd es ou ti ha ing le de ra".split()


def sentence(rng: random.Random, words: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES) for _ in range(rng.randint(1, 4))) for _ in range(words))


def frame(spark, rows):
    """Rows (doc_id, text) as documents with clashing extra columns."""
    return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), *EXTRA) for i, t in rows], SCHEMA)


def awkward_rows():
    rng = random.Random(4)
    long_text = sentence(rng, 30_000)
    base = sentence(rng, 120)
    rows = [
        (1, None), (2, ""), (3, " \t\n "), (4, "x" * 150_000), (5, long_text), (6, "one"), (7, "two words"),
        (8, base), (9, base), (9, base), (10, base.replace(" ", "  \n")), (None, base), (None, None),
        (11, "é" * 30 + " " + base), (12, "İK ſ   ÅNGSTRÖM " + base), (13, long_text), (14, "\x00 zero \x00"), (15, "😀 🎉 " * 60),
    ]
    return rows


@pytest.fixture(scope="session")
def awkward(spark):
    return frame(spark, awkward_rows())


@pytest.fixture(scope="session")
def no_rows(awkward):
    return awkward.filter(F.lit(False))
