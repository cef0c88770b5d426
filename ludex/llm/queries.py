"""Registered queries of this subpackage: each applies one operator, with production
parameters, to its whole table and returns the full result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ludex.llm import (bpe_count, conversation_repair, decontamination, fm_quality, imatch, jaccard_join, line_templates, packing, pii,
                       quality_rules, source_divergence, suffix_dedup, warc)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.verdicts(_table(spark, sf_dir, "documents"))


ORACLE_SQL["op1_quality_rules"] = quality_rules.VERDICTS_SQL


@query
def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_table(spark, sf_dir, "documents"))


@query
def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


ORACLE_SQL["op3_decontamination"] = decontamination.REPORT_SQL


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_templates.dedup(_table(spark, sf_dir, "documents"), report=True)


ORACLE_SQL["op4_line_dedup"] = line_templates.REPORT_SQL


@query
def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_count.count_tokens(_table(spark, sf_dir, "documents"))


@query
def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fm_quality.score_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


@query
def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(_table(spark, sf_dir, "documents"))


@query
def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join_components(_table(spark, sf_dir, "documents"))


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


@query
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


@query
def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair_digests(_table(spark, sf_dir, "conversations"))


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(_table(spark, sf_dir, "documents"))


ORACLE_SQL["op12_source_divergence"] = source_divergence.AUDIT_SQL


@query
def op13_imatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imatch.fingerprints(_table(spark, sf_dir, "documents"))


ORACLE_SQL["op13_imatch"] = imatch.FINGERPRINTS_SQL
