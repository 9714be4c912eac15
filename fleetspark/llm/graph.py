"""Connected components of a graph given as a table of edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetspark.session import cut


def components(edges: DataFrame) -> DataFrame:
    """``a``, ``b`` (long) to ``node``, ``root``: the smallest node reachable, for every node that has an edge.

    Each round hangs larger neighbours, then smaller ones, under the smallest neighbour; paths halve at least, so the
    number of rounds follows the logarithm of the longest path. A node with many edges is aggregated before it moves.
    """
    def star(edges: DataFrame, large: bool) -> DataFrame:
        both = edges.union(edges.select("b", "a")) if large else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("c"), F.least("a", "m").alias("m"))
        joined = both.join(low, F.col("a") == F.col("c"))
        if large:
            return joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(low.select("c", "m")).distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    last, now = None, state(edges)
    while now != last:
        edges = cut(star(star(edges, True), False))
        last, now = now, state(edges)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select("b", "b").distinct())
