"""Connected components of links between numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from culprit.llm.shared import settled


def _print_of(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of `links` (a, b) that is not the smallest it reaches.

    Rounds of two steps, until nothing moves: every node hands the smallest node around
    it to its larger neighbours, then to its smaller ones.  Paths shorten by half or
    better, so rounds grow with the logarithm of the longest.  Smallest neighbours are
    settled before they meet the edges again: both sides of that join are then plain
    shuffles, which Spark splits when a node with very many links makes one large.
    """
    edges = settled(
        links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .where("a <> b")
        .distinct()
    )
    last = _print_of(edges)
    while last[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = settled(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low")))
        wide = settled(
            both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).distinct()
        )
        low = settled(wide.groupBy("a").agg(F.min("b").alias("low")))
        near = wide.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        edges = settled(
            near.unionByName(low.withColumnRenamed("low", "b")).where("a <> b").distinct()
        )
        now = _print_of(edges)
        if now == last:
            break
        last = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
