"""From raw documents to packed training sequences.

Each stage takes the documents that the one before it kept, written as Parquet, and returns documents again; the last
one returns pieces of sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelens.llm.common import fresh, table, written
from pagelens.llm.decontaminate import without_benchmark
from pagelens.llm.packing import pack
from pagelens.llm.quality import rated, train
from pagelens.llm.queries import vocabulary_path
from pagelens.llm.secrets import redacted, scan
from pagelens.llm.simhash import keep_one


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which the neighbours' vote for quality is one half or more. A document without a text goes; one without an id is judged as any other."""
    model = train(docs, table(spark, sf_dir, "labels"))
    score = fresh(docs, "_quality")
    return rated(docs, model, score).filter((F.col("text") != "") & (F.col(score) >= 0.5)).select(*docs.columns)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id."""
    return keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return without_benchmark(docs, table(spark, sf_dir, "benchmark"))


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of each secret and n_chars to match."""
    found = scan(docs).withColumn("text", redacted(F.col("text"), F.col("secrets")))
    return found.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 4096 tokens."""
    return pack(docs, vocabulary_path())


STAGES = [
    ("quality classifier", quality_stage),
    ("SimHash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secret_stage),
    ("packing", packing_stage),
]

#: SQL can't express the stages; tests/llm/test_pipeline.py holds each against a plain version or planted cases.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
