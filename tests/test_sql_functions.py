"""SQL functions next to the Column expressions they stand for, on awkward text."""

from pyspark.sql import functions as F

from ambersift.functions import paths as P
from ambersift.functions import severity as S
from ambersift.functions import text as T
from ambersift.functions.register import register

TEXTS = [
    None, "", " \t\n", "it's a \\ back\\slash", "password = 'hunter2hunter2'", 'api_key: "abcdefgh12"', "AKIA" + "A" * 16,
    "x ghp_" + "a" * 36 + " y", "eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12, "-----BEGIN KEY-----", "Größe\u00a0日本",
    "a/node_modules/b.JS", "/vendor/x.tar.gz", "noext", "dir.d/file", "a\nb.py", " critical ", "HIGH", "low", "$1 \\1 {x}",
    "token" + " " * 41 + "= abcdefghij", "sk-" + "Z" * 30,
]


def test_sql_functions_equal_columns(spark):
    register(spark, "am_")
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    t = F.col("t")
    columns = {
        "redact_secrets": T.redact_secrets(t), "has_sensitive_value": T.has_sensitive_value(t), "is_vendored": P.is_vendored(t),
        "file_extension": P.extension(t), "sarif_level": S.sarif_level(t), "severity_rank": S.severity_rank(t),
        "shannon_entropy": T.shannon_entropy(t), "semantic_class": S.semantic_class(t),
    }
    got = rows.select(
        t, *[c.alias(n) for n, c in columns.items()], *[F.expr(f"am_{n}(t)").alias(f"sql_{n}") for n in columns]
    ).collect()
    differ = [(r.t, n, r[n], r[f"sql_{n}"]) for r in got for n in columns if r[n] != r[f"sql_{n}"]]
    assert not differ and len(got) == len(TEXTS)
