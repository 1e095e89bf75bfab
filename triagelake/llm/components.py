"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm.common import stored


def _smallest(edges: DataFrame) -> DataFrame:
    """Smallest neighbour of each node, the node itself included."""
    return edges.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return (both.join(_smallest(both), "a").where("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct())


def _small_star(edges: DataFrame) -> DataFrame:
    low = _smallest(edges)
    return (edges.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionAll(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())


def components(links: DataFrame) -> DataFrame:
    """links (a, b) -> (a, b): every linked node but the smallest of its component, and that smallest node.

    A node's neighbours are only ever aggregated (min) and joined, never held
    together, so one node may have any number of links. Each round is stored.
    """
    edges = stored(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .distinct())
    state = None
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state or now[0] == 0:
            return edges
        state = now
        edges = stored(_small_star(_large_star(edges)))
