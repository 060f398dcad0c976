"""The corpus pipeline: quality, near copies, secrets, mix, packing; each stage is written and reread.

Every stage takes all documents that its predecessor kept, and all but the last return the
columns of ``documents``.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridfold.llm import mixing, packing, quality, secrets, sketches
from gridfold.session import scratch

WORDS = 5  # words in a shingle of the near-copy stage


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weak-label classifier accepts (operator 6); texts without words go."""
    return quality.judge(docs).where("accepted").drop("quality_score", "accepted")


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 (operator 5)."""
    return sketches.one_of_each(docs, words=WORDS, percent=80)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their secrets replaced by a mark (operator 1)."""
    return secrets.redact(docs, secrets.Scanner.fit(docs))


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights (operator 7): documents repeat or go by quota."""
    return mixing.mix_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-budget batches in optimal length buckets (operator 2), with the text of each piece."""
    return packing.pack(docs, with_text=True)


STAGES = [("quality", quality_stage), ("near copies", near_copy_stage), ("secrets", secret_stage), ("mixing", mix_stage), ("packing", packing_stage)]
ORACLE_SQL = None  # trained stages have no SQL form; tests hold each stage against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, f"pipeline-{name.replace(' ', '-')}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
