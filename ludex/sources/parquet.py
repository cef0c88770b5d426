"""Parquet scan and sink (the hand-off format between every stage)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ludex.session import scratch_path


def read_table(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Scan a Parquet table. Projection and filters applied later are pushed into the scan
    by the optimizer; ``columns`` only makes the projection explicit."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (),
                cluster_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Write a table. ``cluster_by`` range-partitions and sorts rows by the lookup key, so
    each file holds a narrow key range and a point lookup reads few row groups (Parquet
    min/max statistics prune the rest). A row hash is the last range key, so one hot key
    can still be split over several write tasks. Rows are sorted by the partition columns
    first, as the partitioned writer needs, so the key order inside files is kept."""
    if cluster_by:
        row_hash = F.xxhash64(*[F.col(c) for c, kind in df.dtypes if not kind.startswith("map")])
        # The folder columns come first, so a task writes few folders.
        df = df.repartitionByRange(*[F.col(c) for c in (*partition_by, *cluster_by)], row_hash) \
               .sortWithinPartitions(*partition_by, *cluster_by)
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def roundtrip(df: DataFrame, name: str = "roundtrip") -> DataFrame:
    """Write ``df`` under the shared folder and read it back (also a lineage cut)."""
    path = scratch_path(df.sparkSession, name)
    write_table(df, path)
    return df.sparkSession.read.parquet(path)
