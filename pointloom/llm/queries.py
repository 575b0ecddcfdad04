"""The registered text queries and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pointloom.llm import (
    collocations,
    decontaminate,
    embedding_dedup,
    language_model,
    licenses,
    pieces,
    quality_model,
    quality_rules,
    secrets,
    simhash,
    source_audit,
    token_files,
    url_filter,
)
from pointloom.llm.common import shared_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(_table(spark, sf_dir, "documents"))


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_spans(_table(spark, sf_dir, "documents"))


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"))


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_table(spark, sf_dir, "documents"))


def op5_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score_texts(_table(spark, sf_dir, "documents"))


def op6_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encoded_digest(_table(spark, sf_dir, "documents"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/pointloom-tokens-{uuid.uuid4().hex}"
    return token_files.written_and_read(_table(spark, sf_dir, "documents"), path)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.judged(_table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.divergence(_table(spark, sf_dir, "documents"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.embedding_classes(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_secrets": op1_secrets,
    "op2_quality_model": op2_quality_model,
    "op3_url_filter": op3_url_filter,
    "op4_licenses": op4_licenses,
    "op5_language_model": op5_language_model,
    "op6_pieces": op6_pieces,
    "op7_token_files": op7_token_files,
    "op8_quality_rules": op8_quality_rules,
    "op9_decontaminate": op9_decontaminate,
    "op10_simhash": op10_simhash,
    "op11_collocations": op11_collocations,
    "op12_source_audit": op12_source_audit,
    "op13_embedding_dedup": op13_embedding_dedup,
}

ORACLE_SQL: dict[str, str] = {
    "op3_url_filter": url_filter.sql(),
    "op8_quality_rules": quality_rules.sql(),
    "op9_decontaminate": decontaminate.sql(),
    "op11_collocations": collocations.sql(),
    "op12_source_audit": source_audit.sql(),
}
