"""Connected components by alternating large-star and small-star steps, DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import drop, save


def _to_least(pairs: DataFrame) -> DataFrame:
    """For pairs (u, v), the least of each u's group and u itself; partial aggregation keeps hot u cheap."""
    return pairs.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))


def connected_components(links: DataFrame) -> DataFrame:
    """links(a, b): undirected links between nodes of any orderable type; nulls and loops are ignored.

    Returns (node, component): every node of a link with the least node reachable from it. No links give an
    empty table. Each step joins each pair with its group's least node (a plain equi-join, which adaptive
    execution splits on hot nodes) and drops repeats; the number of steps grows with the logarithm of the
    longest path. The tables of each step lie in the shared folder.
    """
    pairs = save(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")), "links")
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        grown = save(both.join(_to_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")), "large")
        small = grown.join(_to_least(grown), "u").select("u", "v", "least")
        small = small.select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(small.select("u", F.col("least").alias("v"))).where("u <> v").distinct()
        stepped = save(small, "small")
        drop(grown)
        drop(pairs)
        pairs = stepped
        if _are_stars(pairs):
            break
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _are_stars(pairs: DataFrame) -> bool:
    """Whether every node points to one other, which points nowhere."""
    ends = pairs.select("u", F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(pairs.select(F.col("v").alias("u"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("u").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 or up > 0 and down > 0").isEmpty()
