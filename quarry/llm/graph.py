"""Connected components by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def components(links: DataFrame) -> DataFrame:
    """(id, component) of the ids in links (a, b), but for each component's smallest; component is the smallest id that can be reached.

    Each round hangs every node's larger neighbours, then its smaller ones, under its smallest neighbour; links shrink to
    stars in a number of rounds that grows with the logarithm of the longest path. It ends when all links are stars
    under their smallest id. Nothing is collected.
    """
    now = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    while True:
        both = now.select("a", "b").union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        now = stored(small, "links")
        if are_stars(now):
            return now.select(F.col("a").alias("id"), F.col("b").alias("component"))


def are_stars(links: DataFrame) -> bool:
    """Whether every larger end a of links (a, b) hangs under one b, and no b under another."""
    ends = links.select(F.col("a").alias("id"), F.lit(1).alias("under"), F.lit(0).alias("over")).union(links.select("b", F.lit(0), F.lit(1)))
    return ends.groupBy("id").agg(F.sum("under").alias("under"), F.max("over").alias("over")).where("under > 1 or under > 0 and over > 0").count() == 0
