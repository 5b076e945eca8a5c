"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    # c is u, but not to the planner: both sides are dealt anew, so that AQE may split the edges of a node that a third of all have
    least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").bitwiseXOR(F.lit(0)).alias("c"), F.least("u", "m").alias("m"))
    return both.join(least, both["u"] == least["c"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least.withColumnRenamed("u", "c"), F.col("u") == F.col("c")).where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).union(moved).distinct()


def _nodes(stars: DataFrame) -> DataFrame:
    """(node, component) of edges that are stars; ``dropped`` deletes the table beneath."""
    out = stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out.stored_at = stars.stored_at
    return out


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node hangs on one other, which hangs on none."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()


def contracted(edges: DataFrame, name: str, rounds: int = 1) -> DataFrame:
    """(node, component) after a few rounds: nodes with equal components are connected, but connected nodes may still differ."""
    current = edges.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    for _ in range(rounds):
        current = stored(_small_star(_large_star(current)), name)
    up = current.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    out = up.union(current.select(F.col("v").alias("node")).distinct().join(up, "node", "left_anti").select("node", F.col("node").alias("component")))
    out.stored_at = current.stored_at
    return out


def components(edges: DataFrame, name: str = "components", most_rounds: int = 60) -> DataFrame:
    """(node, component) of each node in ``edges`` (u, v); component is the smallest node reachable.

    Alternating large-star and small-star rounds: each node's neighbours are
    hung on the smallest one, until the edges are stars. A round is a fixed
    number of shuffles over at most as many edges as before; its result is
    written to the shared folder, so a lost executor costs one round at most,
    and the table before it is deleted. Only whether the edges are stars reaches
    the driver. Loops and repeated edges don't matter; nulls are dropped; no
    edges give no rows.
    """
    start = edges.where("u is not null and v is not null and u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    current = stored(start.distinct(), name)
    for _ in range(most_rounds):
        if _are_stars(current):
            return _nodes(current)
        before, current = current, stored(_small_star(_large_star(current)), name)
        dropped(before)
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
