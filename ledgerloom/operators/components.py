"""Connected components of a graph, in a number of steps that grows with the logarithm of its longest path."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def components(edges: DataFrame, checkpoint: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """node and root (the least node that it can reach) of the edges (a, b); nodes of any type that has an order.

    Every step turns the edges of a node toward the least node that it knows: first those to larger neighbours, then those
    to smaller ones. When a step changes nothing, all edges lead from a node to its root. A step is made of aggregates and
    joins on the node, and its edges are checkpointed; the driver sees a count and a checksum.
    """
    edges = checkpoint(edges.select(F.greatest("a", "b").alias("high"), F.least("a", "b").alias("low")).filter("high <> low").distinct())
    seen = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("high", "low").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
        around = edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low"))).toDF("node", "next")
        least = around.groupBy("node").agg(F.min("next").alias("least")).withColumn("least", F.least("least", "node"))
        upward = around.filter("next > node").join(least, "node").select(F.col("next").alias("node"), "least").filter("node <> least").distinct()
        root = upward.groupBy("node").agg(F.min("least").alias("root"))
        downward = upward.join(root, "node").select(F.col("least").alias("node"), "root").unionByName(root)
        edges = checkpoint(downward.filter("node <> root").distinct().toDF("high", "low"))
    return edges.toDF("node", "root").unionByName(edges.select(F.col("low").alias("node"), F.col("low").alias("root")).distinct())
