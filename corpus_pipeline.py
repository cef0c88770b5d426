"""The corpus pipeline: each stage reads what the one before wrote, as Parquet.

1. quality classifier: documents that the factorisation machine rejects go;
2. line dedup: lines of recurring templates go from the texts, and lines that stand in a few
   (long ones) or more documents unlike each other;
3. n-gram Jaccard join: of each group of near copies one document stays;
4. benchmark decontamination: documents that hold a benchmark item go, verbatim or with other
   values;
5. packing: what is left becomes pieces of training sequences.

All stages but the last return the columns of ``documents``. Nulls, empty texts, repeated
rows, clashing columns and empty tables are as each operator's docstring says; an empty
table passes through all stages and gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ludex.llm import decontamination, fm_quality, jaccard_join, line_templates, packing
from ludex.session import materialize


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return fm_quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_recurring_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return line_templates.dedup(docs, long_docs=line_templates.LONG_DOCS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.keep_one(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality classifier", keep_good_quality), ("line dedup", drop_recurring_lines),
          ("n-gram Jaccard join", drop_near_copies), ("benchmark decontamination", drop_benchmark_leaks),
          ("packing", pack_sequences)]

# Training a model and tokenizing have no SQL form: tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
