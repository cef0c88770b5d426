"""Equi-joins with the source's null-key option.

The source's merges match a null key with null keys. Here the default is SQL equality
(a null key matches nothing); ``null_safe=True`` reproduces the source with a null-safe
comparison, still a hash or sort-merge equi-join. Null is one key value then, and may hold a
third of the left rows (libraries without items), so null-keyed rows are dealt to ``SALTS``
sub-keys and the few null-keyed right rows are repeated for each of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SALTS = 64


def left_join(left: DataFrame, right: DataFrame, key: str, null_safe: bool = False, salts: int = SALTS) -> DataFrame:
    """``left`` left-joined to ``right`` on ``key`` (one ``key`` column in the result)."""
    if not null_safe:
        return left.join(right, key, "left")
    # The salt is a row's place in its task: the same rows again if the task runs again.
    salt = F.when(F.col(key).isNull(), F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).otherwise(F.lit(0))
    every = F.when(F.col(key).isNull(), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    left = left.withColumn("_salt", salt)
    r = right.withColumn("_rsalt", F.explode(every)).withColumnRenamed(key, "_rkey")
    return left.join(r, left[key].eqNullSafe(r["_rkey"]) & (F.col("_salt") == F.col("_rsalt")), "left").drop("_rkey", "_salt", "_rsalt")
