"""Profiling aggregates (G1-G14) and top-k.

All are single-pass aggregations with map-side partial aggregation. Totals used as
denominators come from a scalar subquery (one number, planned by the optimizer), never
from an un-partitioned window over rows.

Null keys: the source project's ``groupby`` drops null keys, so every grouped operator
here drops them too, except where a null is explicitly counted.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ludex.functions.clean import round2
from ludex.session import materialize


def _rows(df: DataFrame) -> Column:
    """Row count of ``df`` as a scalar-subquery column."""
    return df.select(F.count(F.lit(1))).scalar()


def group_size(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """G1: rows per group (null keys dropped)."""
    return df.na.drop(subset=list(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


def sum_per_group(df: DataFrame, key: str, value: str, alias: str | None = None) -> DataFrame:
    """Sum per group; a group whose values are all null sums to 0."""
    return (df.where(F.col(key).isNotNull()).groupBy(key)
              .agg(F.coalesce(F.sum(value), F.lit(0)).alias(alias or value)))


def value_percentages(df: DataFrame, column: str) -> DataFrame:
    """Count and percentage of *all* rows per non-null value (nulls count in the
    denominator, not in the list); percentage rounded as numpy does."""
    total = _rows(df)
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    return counts.withColumn("pct", round2(F.lit(100.0) * F.col("rows") / total))


def null_profile(df: DataFrame) -> DataFrame:
    """Per column its type, not-null %, null % and null count — one pass."""
    n = F.count(F.lit(1))
    aggs = [n.alias("_n")] + [F.count(F.col(f"`{c}`")).alias(f"_c{i}") for i, c in enumerate(df.columns)]
    one = df.agg(*aggs)
    stack = F.explode(F.array(*[
        F.struct(F.lit(c).alias("name"), F.lit(df.schema[c].dataType.simpleString()).alias("data_type"),
                 F.col(f"_c{i}").alias("not_null"))
        for i, c in enumerate(df.columns)])).alias("s")
    rows = one.select("_n", stack)
    not_null_pct = F.lit(100.0) * F.col("s.not_null") / F.col("_n")
    return rows.select(
        F.col("s.name").alias("name"), F.col("s.data_type").alias("data_type"),
        round2(not_null_pct).alias("not_null_pct"),
        round2(F.lit(100.0) - not_null_pct).alias("null_pct"),
        (F.col("_n") - F.col("s.not_null")).alias("null_count"))


def combination_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows and percentage of all rows per (a, b), null keys dropped."""
    total = _rows(df)
    c = df.na.drop(subset=[a, b]).groupBy(a, b).agg(F.count(F.lit(1)).alias("rows"))
    return c.withColumn("pct", F.lit(100.0) * F.col("rows") / total)


def distinct_count_with_null(df: DataFrame, column: str) -> DataFrame:
    """Number of distinct values, null counted as one value."""
    return df.agg((F.count_distinct(F.col(column))
                   + F.max(F.col(column).isNull().cast("int"))).alias("distinct_values"))


QUARTILES = {"q25": 0.25, "q50": 0.5, "q75": 0.75}
CELLS_PER_UNIT = 256             # first histogram: cells of 1 / 256 in the logarithm of a value
SPLITS = 4096                    # further histograms: parts of each cell still of interest
EXACT_ROWS = 200_000             # cells with this many rows in all are read value by value


def describe(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, sample std, min, exact quartiles (linear interpolation), max.

    The quartiles' ranks are found by ``values_at``: counts per cell of a histogram, never a
    sort or a written table. These counts run when the query is built, the rest with it."""
    x = F.col(column).cast("double")
    stats = df.agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.stddev_samp(x).alias("std"),
                   F.min(x).alias("min"), F.max(x).alias("max"))
    found = values_at(df.select(x.alias("v")), list(QUARTILES.values()))
    quartiles = [F.lit(v).cast("double").alias(name) for name, v in zip(QUARTILES, found, strict=True)]
    return stats.select("count", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "min", *quartiles, "max")


def values_at(values: DataFrame, shares: Sequence[float]) -> list[float | None]:
    """The values of column ``v`` (nulls aside, NaN last) at these shares of the ranks,
    interpolated linearly; None without values.

    Selection by refining histograms. The first pass counts rows in cells of a fixed grid that
    grows with the logarithm of a value, so outliers don't empty it; each cell also has its
    least and largest value. A rank's cell follows from the counts. A cell of one value is
    done; cells with up to ``EXACT_ROWS`` rows in all are read by one count per value; larger
    ones are split into ``SPLITS`` parts between their least and largest value and counted
    again. Two passes up to that many rows in the cells, three for thousands of times as many.
    A pass brings to the driver one row per occupied cell, a bounded number."""
    v = F.col("v")
    rows = values.where(v.isNotNull())
    grid = (F.when(F.isnan(v), F.lit(1 << 40)).when(v == float("inf"), F.lit(1 << 39)).when(v == float("-inf"), F.lit(-(1 << 39)))
             .otherwise(F.floor(F.signum(v) * F.log1p(F.abs(v)) * CELLS_PER_UNIT)))
    facts = [F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")]
    cells = sorted((tuple(r) for r in rows.groupBy(grid.alias("cell")).agg(*facts).collect()), key=lambda r: r[0])
    total = sum(n for _, n, _, _ in cells)
    if not total:
        return [None for _ in shares]
    places = [share * (total - 1) for share in shares]
    ranks = sorted({int(p) for p in places} | {-int(-p // 1) for p in places})
    found: dict[int, float] = {}
    parts, before = [(n, lo, hi) for _, n, lo, hi in cells], 0
    wanted = _locate(parts, before, ranks, found)
    while wanted:
        inside = [F.col("v").between(lo, hi) for lo, hi, _, _ in wanted]
        near = rows.where(reduce(lambda a, b: a | b, inside))
        which = reduce(lambda c, i: c.when(inside[i], i), range(1, len(inside)), F.when(inside[0], 0))
        if sum(n for _, _, n, _ in wanted) <= EXACT_ROWS:
            part = v
        else:
            lo, width = ([F.lit(w) for w in side] for side in ([w[0] for w in wanted], [w[1] - w[0] for w in wanted]))
            place = [F.least(F.floor((v - lo[i]) / width[i] * SPLITS), F.lit(SPLITS - 1)).cast("double") for i in range(len(wanted))]
            part = reduce(lambda c, i: c.when(inside[i], place[i]), range(1, len(inside)), F.when(inside[0], place[0]))
        counted = near.groupBy(which.alias("w"), part.alias("p")).agg(*facts).collect()
        again = []
        for i, (_, _, _, start) in enumerate(wanted):
            own = sorted(((r["p"], r["n"], r["lo"], r["hi"]) for r in counted if r["w"] == i), key=lambda r: r[0])
            again += _locate([r[1:] for r in own], start, ranks, found)
        wanted = again
    out = []
    for p in places:
        lo, hi = found[int(p)], found[-int(-p // 1)]
        out.append(lo + (hi - lo) * (p - int(p)))
    return out


def _locate(parts: Sequence[tuple[int, float, float]], before: int, ranks: Sequence[int], found: dict[int, float]) -> list[tuple]:
    """Ranks in ordered parts (rows, least, largest) that ``before`` rows precede: those in a
    part of one value go to ``found``; of other parts that hold one, (least, largest, rows,
    rows before)."""
    out = []
    for n, lo, hi in parts:
        here = [r for r in ranks if r not in found and before <= r < before + n]
        if here and (lo == hi or lo != lo):
            found.update((r, lo) for r in here)
        elif here:
            out.append((lo, hi, n, before))
        before += n
    return out


def running_total(df: DataFrame, order: Sequence[Column], value: str, alias: str) -> DataFrame:
    """Sum of ``value`` up to and including each row in a global order. Rows are range
    partitioned (and written, as ranges come from a sample), summed within partitions, and
    shifted by the totals of the partitions before: one row a partition is windowed."""
    ranged = materialize(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    totals = ranged.groupBy("_part").agg(F.sum(value).alias("_t"))
    before = totals.select("_part", F.coalesce(F.sum("_t").over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return (ranged.withColumn("_own", own).join(before, "_part")
                  .withColumn(alias, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before"))


def top_values(df: DataFrame, column: str, k: int = 5) -> DataFrame:
    """The ``k`` most frequent non-null values, ties by value ascending."""
    c = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("rows"))
    return ranked_top(c, [F.col("rows").desc(), F.col(column).asc()], k)


def ranked_top(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Global top-k with an explicit ``rank`` (the sort runs as a bounded
    take-ordered; the rank is numbered over those k rows only)."""
    top = df.orderBy(*order).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def sorted_positions(df: DataFrame, key: str, ascending: bool = True) -> DataFrame:
    """Rows per ``key`` value numbered in key order with nulls last (Spark's default
    puts nulls first when ascending). Positions come from range partitions, not one window."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    o = F.col(key).asc_nulls_last() if ascending else F.col(key).desc_nulls_last()
    numbered = running_total(counts.withColumn("_one", F.lit(1)), [o], "_one", "pos")
    return numbered.select(key, "rows", F.col("pos").cast("int").alias("pos"))
