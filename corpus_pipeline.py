"""Corpus pipeline: quality rules, near-duplicates, benchmark decontamination, secrets, SentencePiece ids.

Each stage gets what its predecessor kept, reread from Parquet, and its decisions take effect: bad documents, further
copies and documents with benchmark passages go, secrets are overwritten, and the last stage adds the ids. All stages
but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pointloom.llm.common import saved
from pointloom.llm.decontaminate import drop_contaminated
from pointloom.llm.pieces import tokenized
from pointloom.llm.quality_rules import keep_good
from pointloom.llm.secrets import redacted
from pointloom.llm.simhash import keep_one


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules keep, without failing lines. Null and empty texts go: they have too few words."""
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest id (null last). All texts without words are copies of one another."""
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage. A null or empty text has none and stays."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets overwritten. Null and empty texts stay as they are."""
    return redacted(docs)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their piece ids. A null or empty text has none."""
    return tokenized(docs)


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("sentencepiece", sentencepiece),
]

#: The similarity groups of the second stage and the ids of the last are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
