"""Connected components of an edge list, by alternating large-star and small-star steps.

Every step is a minimum per node (partial aggregation) and an equi-join that AQE can
split, so hubs are never gathered; the edges stay about as many throughout and each
round is checkpointed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.runtime import cut


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest node each node of an edge reaches, itself included."""
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    pairs = cut(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = None
    while True:
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if state[0] == 0 or state == seen:
            break
        seen = state
        pairs = cut(_small_star(_large_star(pairs)))
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def contracted(groups: DataFrame, edges: DataFrame) -> DataFrame:
    """``groups`` (node, component) after ``edges`` (a, b) between components or single nodes."""
    merged = cut(components(edges))
    to = merged.select(F.col("node").alias("component"), F.col("component").alias("to"))
    moved = groups.join(to, "component", "left").select("node", F.coalesce("to", "component").alias("component"))
    return cut(moved.unionByName(merged.join(groups, "node", "left_anti")))


def _large_star(pairs: DataFrame) -> DataFrame:
    """Each neighbour larger than a node is tied to the smallest around the node."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    # pairs that coincide become one in the small step, so the shuffle for that is made once a round
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(pairs: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are tied to the smallest of these."""
    down = pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    ties = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
    return ties.unionByName(low.select("u", F.col("m").alias("v"))).distinct()
