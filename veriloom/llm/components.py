"""Connected components of an edge table by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return (both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    linked = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return linked.where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()


def _only_stars(edges: DataFrame) -> bool:
    """Each leaf has one root and no root is a leaf."""
    ends = (edges.select(F.col("u").alias("node"), F.lit(1).alias("leaf"), F.lit(0).alias("root"))
            .union(edges.select("v", F.lit(0), F.lit(1))))
    bad = (ends.groupBy("node").agg(F.sum("leaf").alias("leaf"), F.max("root").alias("root"))
           .where("leaf > 1 or (leaf = 1 and root = 1)"))
    return bad.isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node on an edge; root is the smallest node reachable.

    ``edges`` has the long columns u and v. Self-loops and rows with a null are
    left out; repeated edges and cycles do no harm; no edge gives no row. Each
    round is two aggregates with map-side combine and two joins, which adaptive
    execution may split where one node has most edges. The rounds, about the
    logarithm of the longest chain, are cut from their lineage by a stored table.
    """
    start = edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    state = stored(start.distinct(), "edges")
    while not _only_stars(state):
        state = stored(_small_star(_large_star(state)), "edges")
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
