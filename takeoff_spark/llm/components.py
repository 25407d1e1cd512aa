"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise


def _large(edges: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to its smallest one (or itself)."""
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of them. edges: a < b."""
    least = edges.groupBy("b").agg(F.min("a").alias("m"))
    joined = edges.join(least, "b")
    return joined.select(F.col("m").alias("a"), F.col("a").alias("b")).where("a < b").union(least.select(F.col("m").alias("a"), "b")).distinct()


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """(node, component) of every node that has a link; the component is its smallest node.

    ``edges`` has longs a and b; direction, repetitions and a = b don't matter. An edge table without
    links gives none. Every round is written to the shared folder; the driver sees counts only.
    """
    now = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    mark = None
    for _ in range(most_rounds):
        now = materialise(_small(_large(now)), "star")
        new = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if new == mark or not new[0]:
            break
        mark = new
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).union(now.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct())
