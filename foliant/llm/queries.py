"""The registered queries of the corpus operators, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import (
    decontam,
    exact_dedup,
    language_id,
    line_dedup,
    mixing,
    ngram_join,
    pii,
    sharding,
    url_filter,
    warc,
)
from foliant.llm.common import table


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = url_filter.rules_frame(spark, url_filter.RULES)
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup_report(table(spark, sf_dir, "documents"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.ngram_components(table(spark, sf_dir, "documents"), k=4, similarity=(85, 100))
    return found.select("doc_id", "n_shingles", "component_id")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents"), max_epochs=mixing.MAX_EPOCHS)


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_report(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filters": op1_url_filters,
        "op2_pii": op2_pii,
        "op3_line_dedup": op3_line_dedup,
        "op4_ngram_join": op4_ngram_join,
        "op5_warc": op5_warc,
        "op6_decontamination": op6_decontamination,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_mixing": op8_mixing,
        "op9_sharding": op9_sharding,
        "op10_language_id": op10_language_id,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_url_filters": url_filter.ORACLE_SQL,
        "op3_line_dedup": line_dedup.ORACLE_SQL,
        "op5_warc": warc.ORACLE_SQL,
        "op7_exact_dedup": exact_dedup.ORACLE_SQL,
    }
