"""Connected components by alternating large-star and small-star steps.

Edges live in Spark only; each round is written to the shared folder, which
cuts the lineage. A node with very many neighbours is aggregated before the
shuffle, and joins meet its edges as a skewed side that Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import materialize


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Links neighbours of each u (larger ones, or the smaller ones and u) to u's smallest neighbour."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    least = least.select("u", F.least("u", "m").alias("m"))
    if larger:
        return pairs.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    down = pairs.where("v < u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return down.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node of an edge; root is the smallest node of its component."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct()
    e = materialize(e, "cc-edges")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _star(both, True).where("u <> v")
        # after the large star every edge points to a smaller node
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most"))
        rest = large.join(least.where("m < most").select("u", "m"), "u").where("v <> m").select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        new = least.select("u", F.col("m").alias("v")).unionByName(rest).where("u <> v").distinct()
        new = materialize(new, "cc-edges")
        # done when every edge goes from a leaf to the leaf's only root
        roots = new.select(F.col("v").alias("u")).distinct()
        several = new.groupBy("u").agg(F.min("v").alias("a"), F.max("v").alias("b")).where("a < b").select("u")
        if roots.join(new, "u", "left_semi").unionByName(several).isEmpty():
            break
        e = new
    return new.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        new.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
