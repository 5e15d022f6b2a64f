"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinetrove.llm.common import stage


def _large(links: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to its smallest neighbour (itself included)."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stage(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u"), F.least("u", "m").alias("m")), "least")
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(links: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = stage(down.groupBy("u").agg(F.min("v").alias("m")), "least")
    moved = down.join(least, "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _stars(links: DataFrame) -> bool:
    """Whether every node either has one smaller neighbour and no larger one, or larger ones only. ``links``: u > v."""
    ends = links.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.unionByName(links.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    found = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not found.agg(F.max((F.col("up") > 1) | ((F.col("up") > 0) & (F.col("down") > 0)))).first()[0]


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of all linked nodes: the smallest node that can be reached. ``links``: u, v.

    Every round is written to the shared folder, and so are the smallest neighbours: their size is then known when
    they are joined, and a node with very many links is broadcast to or split by Spark. The end is reached when all links
    are stars, so no round is spent on seeing that nothing changes: each is jobs and plans that the driver has to hold.
    """
    now = stage(_small(links.where("u <> v")), "links")
    for _ in range(rounds):
        if _stars(now):
            leaves = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
            return leaves.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        now = stage(_small(_large(now)), "links")
    raise RuntimeError(f"components did not settle within {rounds} rounds")
