"""From raw documents to packed training sequences, one operator per stage.

Each stage takes the documents that its predecessor kept, written as Parquet and
read again, and returns documents with the same columns; the last one returns the
packing plan. Stages: toxicity filter, exact dedup, near-duplicate join (one
document of each group stays), benchmark decontamination, best-fit packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ambersift.llm import toxicity
from ambersift.llm.decontaminate import drop_contaminated
from ambersift.llm.exact_dedup import drop_copies
from ambersift.llm.jaccard_join import drop_near_copies
from ambersift.llm.packing import pack_documents
from ambersift.llm.tables import read, tokenizer
from ambersift.session import shared_dir


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier, fitted to the labelled rows of these documents, scores below 0.7."""
    return toxicity.drop_toxic(docs, toxicity.learn(docs, read(spark, sf_dir, "labels")))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for blanks, the longest, then the smallest id."""
    return drop_copies(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each near-copy group (five-word shingles, Jaccard 0.8), the smallest id."""
    return drop_near_copies(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item, up to a fifth of its words edited."""
    return drop_contaminated(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packing plan: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_documents(docs, tokenizer("word_bpe_49k.json"))


STAGES = [
    ("toxicity", without_toxic),
    ("exact_dedup", without_copies),
    ("ngram_jaccard_join", without_near_copies),
    ("benchmark_decontamination", without_benchmark),
    ("best_fit_packing", packed),
]

#: The toxicity model, the recursive splits and the genetic search have no SQL form;
#: tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
