"""Connected components over edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkwarden.session import stage


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node reachable) of edges (a, b) by large-star and small-star steps.

    Roots themselves have no row. Every step is a staged table, so lost
    executors cost a step at most, and no edges reach the driver. Each node's
    neighbours are only ever aggregated, so a node with many costs no more.
    """
    now = stage(edges.where("a <> b").distinct(), "edges")
    while True:
        # large star: the larger neighbours of a node point to the smallest of it and its neighbours
        near = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = near.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = stage(large.distinct(), "edges")
        # small star: the smaller neighbours of a node and the node itself point to the smallest
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("a", F.col("m").alias("b")))
        now = stage(small.distinct(), "edges")
        # stars: no root is a node, and no node has two roots
        if now.join(now.select(F.col("b").alias("a")), "a", "left_semi").isEmpty() and now.groupBy("a").count().where("count > 1").isEmpty():
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
