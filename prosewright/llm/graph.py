"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prosewright.llm.common import Scratch


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest of itself and its neighbours."""
    near = _both_ways(edges)
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return near.where("v > u").join(least, "u").select(F.col("m").alias("u"), "v").where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours go to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("m").alias("u"), "v")
    return moved.union(least.select(F.col("m").alias("u"), F.col("u").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(u, v) edges to (node, component): the smallest node reachable.  Nodes without an edge are not listed."""
    sign = [F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v") % 1_000_003), F.lit(0)).alias("s")]
    now = scratch.write(edges.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), f"{name}-0")
    before, step = now.agg(*sign).first(), 0
    while before["n"]:
        step += 1
        now = scratch.write(_small_star(_large_star(now)), f"{name}-{step}")
        after = now.agg(*sign).first()
        scratch.drop(f"{name}-{step - 1}")
        if after == before:
            break
        before = after
    return now.select(F.col("v").alias("node"), F.col("u").alias("component")).union(now.select(F.col("u").alias("node"), F.col("u").alias("component"))).distinct()
