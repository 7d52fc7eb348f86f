"""Connected components of a link table by alternating large and small stars.

Each round is two group-and-join steps over the links; nothing is collected.
The work of a round follows the number of links, and the rounds the logarithm
of the longest path.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from satledger.llm.common import discard, store


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("least"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("least").alias("b"))


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("least"))
    moved = down.join(least, "a").where(F.col("b") != F.col("least")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    return moved.union(least.select("a", F.col("least").alias("b")))


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of every node but each component's least, which is its
    ``component``, from links ``a, b``.  Links to itself and null ends are dropped."""
    links = store(links.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    seen = None
    while True:
        new = store(_small_star(_large_star(links)).distinct(), "links")
        state = tuple(new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        discard(links)
        links = new
        if state == seen or not state[0]:
            return links.select(F.col("a").alias("node"), F.col("b").alias("component"))
        seen = state
