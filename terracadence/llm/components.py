"""Connected components by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged


def _with_least(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with m, the least of u and all its v. The minima combine on the map side; the join leaves hubs to skew handling."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return pairs.join(least, "u")


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(node, component) of every node of edges (u, v); the component is its smallest node. Nodes without edges do not occur.

    Alternates large and small stars (each node's larger, then its smaller neighbours are tied to the least one) until
    every edge points at a component's least node, which takes a number of rounds logarithmic in the size of the
    largest component.
    """
    edges = staged(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _with_least(large)
        tied = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        edges = staged(tied.where("u <> v").distinct())
        # done once no node is both tied and a tie, and each is tied once
        ties = edges.select(F.col("v").alias("u")).distinct()
        twice = edges.groupBy("u").count().where("count > 1")
        if edges.join(ties, "u", "left_semi").isEmpty() and twice.isEmpty():
            break
    else:
        raise RuntimeError("components did not converge")
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
