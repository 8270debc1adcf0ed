"""The registered queries of this subpackage and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tabgauge.llm import (
    conversations,
    decontaminate,
    extraction,
    idfiles,
    language,
    licenses,
    neardup,
    ngram_join,
    oracles,
    packing,
    quality,
    secrets,
    spelling,
    token_counts,
)


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def _secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secrets.secrets(_documents(spark, folder))


def _licenses(spark: SparkSession, folder: str) -> DataFrame:
    return licenses.licenses(_documents(spark, folder)).drop("matches")


def _packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_documents(spark, folder))


def _near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.near_duplicates(_documents(spark, folder))


def _decontamination(spark: SparkSession, folder: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{folder}/benchmark.parquet")
    return decontaminate.contamination(_documents(spark, folder), benchmark)


def _id_files(spark: SparkSession, folder: str) -> DataFrame:
    return idfiles.written_and_read(_documents(spark, folder))


def _languages(spark: SparkSession, folder: str) -> DataFrame:
    return language.languages(_documents(spark, folder))


def _main_texts(spark: SparkSession, folder: str) -> DataFrame:
    return extraction.extract(spark.read.parquet(f"{folder}/pages.parquet"))


def _token_counts(spark: SparkSession, folder: str) -> DataFrame:
    return token_counts.counts_after_redaction(_documents(spark, folder))


def _quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality.quality(_documents(spark, folder))


def _conversations(spark: SparkSession, folder: str) -> DataFrame:
    turns = spark.read.parquet(f"{folder}/conversations.parquet")
    return conversations.repair(conversations.damaged(turns))


def _ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.ngram_groups(_documents(spark, folder))


def _spelling(spark: SparkSession, folder: str) -> DataFrame:
    return spelling.variants(_documents(spark, folder), damage=True)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_secrets": _secrets,
        "op2_licenses": _licenses,
        "op3_packing": _packing,
        "op4_near_duplicates": _near_duplicates,
        "op5_decontamination": _decontamination,
        "op6_id_files": _id_files,
        "op7_main_texts": _main_texts,
        "op8_token_counts": _token_counts,
        "op9_quality_rules": _quality,
        "op10_languages": _languages,
        "op11_conversations": _conversations,
        "op12_ngram_join": _ngram_join,
        "op13_spelling_variants": _spelling,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
