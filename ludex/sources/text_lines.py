"""Text lines with their ordinal: a line's place in the whole input, file by file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ludex.session import materialize


def read_numbered_lines(spark: SparkSession, path: str, ordinal: str = "line_no") -> DataFrame:
    """``value`` and ``ordinal`` (0-based, dense; files in path order, lines in file order) of
    every line.

    Two passes, no global sort and no un-partitioned window over lines. A scan reads a split
    (a file from a byte offset) from one task, in order, so ids drawn in that task rise along
    it. The first pass counts the lines of each split and keeps its first id, one row a split
    (written, and summed up in file order); the second adds a line's place in its split to the
    lines of the splits before. Both passes read the same files in the same splits; a task
    that is run again draws the same ids."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"))
    splits = lines.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_id").alias("_first"))
    splits = materialize(splits, "line-splits")
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    splits = splits.select(F.col("_file").alias("_f"), F.col("_start").alias("_s"), (before - F.col("_first")).alias("_shift"))
    return (lines.join(splits, (F.col("_file") == F.col("_f")) & (F.col("_start") == F.col("_s")))
                 .select("value", (F.col("_id") + F.col("_shift")).alias(ordinal)))
