"""Connected components of a written link table by alternating large-star and small-star
steps. All work is joins and aggregations over links; nothing is collected. Each step is
pre-aggregated per node, and its result is written, so lineage stays short."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ludex.session import materialize


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a > b). Large: every node's larger neighbours move to its
    smallest one; small: its smaller neighbours, and itself, do."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges
    low = F.least(F.first("a"), F.min("b")) if large else F.min("b")
    least = both.groupBy(F.col("a").alias("u")).agg(low.alias("m"))
    least = materialize(least, "least-neighbours")
    moved = both.join(least, both["a"] == least["u"])
    if large:
        moved = moved.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return moved.where(F.col("a") > F.col("b")).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b); the component is its smallest
    node. Loops and repeated links are allowed; null ends are dropped."""
    edges = (links.where(F.col("a") != F.col("b"))
                  .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    edges = materialize(edges, "edges")
    state = None
    while True:
        edges = materialize(_star(materialize(_star(edges, True), "large-star"), False), "small-star")
        # Stable once every node hangs on one root: compared by count and order-free sums.
        row = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.col("b").cast("decimal(38,0)"))).first()
        if tuple(row) == state:
            break
        state = tuple(row)
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component")))
