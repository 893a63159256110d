"""Connected components of a graph given as edges, by alternating large-star and small-star steps.

Each step is a grouped minimum (pre-aggregated before the shuffle) and a join back, which adaptive execution can split, so a
node with very many neighbours does not meet in one task. The edges of a round are a stored table, which replaces the one before.
Rounds go on while edges change; their number grows with the logarithm of the longest path.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .common import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node points to the node's smallest neighbour (or the node)."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours point to the smallest of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of ``edges(a, b)``; the root is the smallest node of the component. No edges give no rows."""
    scratch = Scratch(edges.sparkSession, "components")
    now = scratch.store(
        "0", edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )  # every edge points down
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    state, n = None, 0
    while True:
        # a fingerprint of the edges, taken while they are written
        seen = Observation()
        n += 1
        moved = _small_star(_large_star(now)).observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h"))
        now = scratch.store(str(n), moved)
        scratch.drop(str(n - 1))
        if seen.get == state:
            break
        state = seen.get
    roots = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
