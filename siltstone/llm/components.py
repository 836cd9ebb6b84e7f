"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch


def connected_components(scratch: Scratch, edges: DataFrame, name: str) -> DataFrame:
    """edges (u, v) -> (node, root) of every node of an edge; root: the smallest node of its component.

    Alternates large-star and small-star steps until nothing changes, about log(n) rounds. A step takes the smallest
    neighbour of each node by aggregation and joins it back, so a node with many neighbours is summed up before it is
    shuffled and its join can be split. Each round is a table in the shared folder; nothing but counts reaches the driver.
    """
    now = scratch.table(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{name}0")
    state, k = None, 0
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # tables, so that both sides of the joins are plain shuffles and Spark can split a node of many neighbours
        least = scratch.table(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), f"{name}{k}least")
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.table(large, f"{name}{k}large")
        down = scratch.table(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}{k}down")
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        after = scratch.table(small, f"{name}{k + 1}")
        scratch.drop(f"{name}{k}", *(f"{name}{k}{part}" for part in ("large", "least", "down")))
        now, k = after, k + 1
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())
        if new == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = new
