"""Connected components by alternating large-star and small-star steps, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written


def _smallest(edges: DataFrame, mirrored: bool) -> DataFrame:
    """Edges (u, v) with the smallest neighbour m of u; the aggregate has one row a node, so a hot node can be split by a skew join."""
    if mirrored:
        edges = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u")


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable over edges (u, v), for every id in an edge.

    Each round keeps connectivity; the stars of the last round are the answer. Self links count as a node only; null ends are ignored.
    """
    edges = written(edges.select("u", "v"), "links")  # read twice, computed once
    nodes = edges.select(F.col("u").alias("id")).union(edges.select(F.col("v").alias("id"))).filter("id IS NOT NULL")
    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v").distinct(), "edges")
    before = None
    for _ in range(most_rounds):
        large = _smallest(now, True).filter("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).filter("u <> v").distinct()
        small = _smallest(large, False)
        stars = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        now = written(stars.filter("u <> v").distinct(), "stars")
        seen = now.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.sum(F.hash("v", "u").cast("long"))).first()
        if seen == before or not seen[0]:
            break
        before = seen
    else:
        raise RuntimeError("components did not settle")
    return nodes.distinct().join(now.select(F.col("u").alias("id"), F.col("v").alias("component")), "id", "left").select("id", F.coalesce("component", "id").alias("component"))
