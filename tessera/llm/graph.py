"""Connected components by alternating star contraction, on DataFrames only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _largest_last(edges: DataFrame) -> DataFrame:
    return edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()


def components(edges: DataFrame, label: str = "cc") -> DataFrame:
    """(node, component) for every node of edges(a, b); a component's id is its smallest node.

    Each round sends a node's neighbours to the smallest of them, by a combined aggregate and a join
    back, so a hub's neighbours are never gathered; O(log n) rounds on chains, two or three on stars.
    """
    now = materialize(_largest_last(edges), f"{label}-0")
    size = lambda d: tuple(d.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    before, k = size(now), 0
    while before[0]:
        # larger neighbours of each node go to the smallest of its neighbourhood
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # (written, so that the join deals both sides anew and can split a hub's neighbours over tasks)
        low = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), f"{label}-{k}-low")
        wide = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        wide = _largest_last(wide)
        # smaller neighbours, and the node, go to the smallest of them
        low = wide.groupBy("a").agg(F.min("b").alias("m"))
        near = wide.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        k += 1
        now = materialize(_largest_last(near.unionByName(low.select("a", F.col("m").alias("b")))), f"{label}-{k}")
        after = size(now)
        if after == before:
            break
        before = after
    tips = now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("node"), "component")
    return tips.unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
