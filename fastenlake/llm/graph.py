"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored


def _star(edges: DataFrame) -> DataFrame:
    """Large star, then small star; edges have u > v."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("low"))
    large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v").distinct()
    least = large.groupBy("u").agg(F.min("v").alias("low"))
    joined = large.join(least, "u")
    small = joined.where("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    return small.unionByName(least.select("u", F.col("low").alias("v"))).where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (u, v): undirected, any comparable type; returns (node, root), root the
    least node of its component, for every node of an edge.  No edge gives no row."""
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        state = now.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if mark == (state["n"], state["h"]) or state["n"] == 0:
            break
        mark = (state["n"], state["h"])
        then = stored(_star(now), "edges")
        forget(now)
        now = then
    roots = now.select("u", "v")
    return roots.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
