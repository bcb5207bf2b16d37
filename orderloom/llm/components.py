"""Connected components of a link table by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import released_shuffles, settle


def _nearest(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the node's smallest neighbour or itself."""
    both = links.union(links.select("v", "u")).toDF("u", "v")
    low = _nearest(both).withColumn("m", F.least("u", "m"))
    return both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(links: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them."""
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = _nearest(down)
    moved = down.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(low.toDF("u", "v"))


def components(links: DataFrame) -> DataFrame:
    """node -> root, the smallest node it reaches, for every node of ``links`` (u, v: long).

    Each round is written to the shared folder, so a lost executor repeats one round.
    Rounds grow with the logarithm of the longest path.
    """
    links = settle(links.filter("u != v").distinct())
    seen = None
    while True:
        links = settle(_small_star(_large_star(links)).filter("u != v").distinct())
        with released_shuffles(links.sparkSession):
            now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return links.toDF("node", "root").union(links.select("v", "v").distinct())
