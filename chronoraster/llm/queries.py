"""Queries of the text operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronoraster.functions.session import table
from chronoraster.llm import encode, forms, mixture


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(table(spark, d, "documents")).select("doc_id", "ids")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return encode.encode_corpus(table(spark, d, "documents")).where("state <> 'text' and size(ids) = 0").select("doc_id")


def _mixture(spark: SparkSession, d: str) -> mixture.Mixture:
    return mixture.measure(table(spark, d, "documents"), table(spark, d, "mix_target"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return mixture.shares(_mixture(spark, d)).where("short").select("source")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixture.shares(_mixture(spark, d))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixture.select(_mixture(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return forms.lookalike_pairs(table(spark, d, "documents"))


def p8_forms(spark: SparkSession, d: str) -> DataFrame:
    return forms.normalize_corpus(table(spark, d, "documents")).select("doc_id", "form", F.hex("form_key").alias("form_key"), "n_mixed", "n_whole")


def p8_classes(spark: SparkSession, d: str) -> DataFrame:
    return forms.lookalike_classes(table(spark, d, "documents"))


def queries() -> dict:
    return {f.__name__: f for f in (p6_found, p6_ids, p7_found, p7_shares, p7_mix, p8_found, p8_forms, p8_classes)}


def oracle_sql() -> dict[str, str]:
    return {"p6_found": "SELECT doc_id FROM documents WHERE text IS NULL OR text = ''"}
