"""Connected components of an undirected graph, by rounds of joins.

Edges are rewritten until each node points at the smallest node of its component (the
alternating star method). Each round is written to the shared folder, so no round repeats
an earlier one, and a hub's edges are counted before they are joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from affectframe.llm.common import stored


def _neighbours(edges: DataFrame) -> DataFrame:
    return edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each larger neighbour of a node is linked to the smallest of the node and its neighbours."""
    both = _neighbours(edges)
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours are linked to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def _tidy(edges: DataFrame) -> DataFrame:
    return edges.filter("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` for the nodes of ``edges`` (``u, v``) that are not their component's smallest.

    The number of rounds grows with the logarithm of the longest path.
    """
    edges = stored(_tidy(edges.select("u", "v")), "edges")
    while True:
        following = stored(_tidy(_small_star(_tidy(_large_star(edges)))), "edges")
        # Done when every edge leads from a node to a root, and to one root only.
        sums = [e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("bigint"))).first() for e in (edges, following)]
        edges = following
        if tuple(sums[0]) == tuple(sums[1]):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
