"""Connected components by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stintline.llm.scratch import Scratch


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link every neighbour of a node (large: the greater ones, small: the smaller ones and itself) to its least neighbour.

    The least neighbour is an aggregate with a map-side combine joined back, so a node with very many neighbours is never
    gathered in one task.
    """
    seen = edges.select("u", "v")
    if large:
        seen = seen.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = seen.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = seen.join(least, "u")
    if large:
        moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return moved.where("u > v").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) of every node on an edge (u, v); the component is the smallest node reachable.

    Direction and repetition do not matter, self-loops and nulls are left out; an empty table gives an empty one.
    """
    now = scratch.write(edges.where("u is not null and v is not null and u <> v")
                        .select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        stars = scratch.write(_star(_star(now, True), False))
        got = stars.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(now)
        now = stars
        if tuple(got) == mark:
            break
        mark = tuple(got)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
