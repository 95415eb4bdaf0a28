"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from weekwatch.session import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One round. Each node ``u`` hands the smallest node it sees to its larger (or smaller) neighbours."""
    if large:
        seen = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:  # every edge seen from its larger end
        seen = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = seen.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    near = seen.join(least, "u")
    if large:
        out = near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u, v)``; the root is the smallest node of its component.

    Each round is written to the shared folder, so lineage stays short and a lost executor costs a re-read. The driver
    holds two numbers a round.
    """
    now = stored(edges.select("u", "v").filter("u <> v"))
    mark = None
    while True:
        after = stored(_star(_star(now, True), False))
        sums = after.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long"))).first()
        now = after
        if sums == mark:
            break
        mark = sums
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
