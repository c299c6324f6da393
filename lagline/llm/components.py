"""Connected components of an edge table, by alternating star rewrites in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lagline.llm.scratch import drop, store


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``(node, component)`` for every node of ``edges(a, b)``; the component is its smallest node.

    Each round hangs every node's larger neighbours on its smallest neighbour, then its smaller ones.
    A round is two aggregations and joins on edge rows, so a node with any number of neighbours is
    never gathered; chains shorten geometrically. Rounds are written to the shared folder. It ends when
    every node hangs directly on one other that hangs on nothing, which one aggregation proves.
    """
    current = store(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), name)
    while True:
        both = current.unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        smallest = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("m"))
        # larger neighbours of each node go to its smallest one (an edge is looked at from its smaller end)
        large = current.join(smallest, F.col("b") == F.col("node")).select("a", F.col("m").alias("b"))
        large = store(large, name)
        # smaller neighbours and the node itself go to the smallest one
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        hung = large.join(least.withColumnRenamed("a", "node"), F.col("a") == F.col("node")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = store(hung.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), name)
        ends = small.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
            small.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        unfinished = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down")).where("up > 1 OR (up > 0 AND down > 0)").limit(1).count()
        drop(current, large)
        current = small
        if not unfinished:
            break
    return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
