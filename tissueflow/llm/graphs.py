"""Connected components by alternating large and small stars (public algorithm), each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, written


def _large(e: DataFrame) -> DataFrame:
    both = e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small(e: DataFrame) -> DataFrame:
    down = e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    near = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return near.union(least.select("a", F.col("m").alias("b"))).filter("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label: the smallest node that can be reached, for every node of edges(a, b). Nodes of no edge are absent."""
    e = written(edges.select("a", "b").filter("a <> b").distinct(), "edges")
    before = None
    while True:
        last, e = e, written(_small(_large(e)), "edges")
        dropped(last)
        now = e.agg(F.count("*"), F.sum(F.shiftright(F.xxhash64("a", "b"), 20))).first()
        if now == before:
            break
        before = now
    stars = e.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.union(stars.select("label", "label").distinct())
