"""Connected components of an edge table, by alternating stars.

Each round relinks neighbours to the least id around (large star, then small
star), until the edges no longer change. Rounds grow with the logarithm of
the longest chain. Minima are pre-aggregated; the joins back are equi-joins,
so Spark splits the edges of a hub. Each round is written to the shared
folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanlake.llm.common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u > v) -> edges (u > v) relinked to minima."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    near = both.join(least, "u")
    if large:
        out = near.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where("u > v").distinct()


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(edges: DataFrame, name: str = "stars") -> DataFrame:
    """edges (a, b) -> (node, root) for each node with an edge other than its
    component's least one, which is the root."""
    edges = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), name)
    before = _sum(edges)
    while before[0]:
        edges = stored(_star(_star(edges, True), False), name)
        now = _sum(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
