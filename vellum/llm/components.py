"""Connected components of an edge table, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.session import durable


def _stars(edges: DataFrame, large: bool, parts: int) -> DataFrame:
    """Point the neighbours of each node at the least of them: those above the node (large) or not above (small)."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    joined = both.join(least, "u")
    if large:
        return joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").coalesce(parts).distinct()
    moved = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionAll(least.select("u", F.col("m").alias("v"))).where("u <> v").coalesce(parts).distinct()


def components(edges: DataFrame, rows_per_task: int = 20_000) -> DataFrame:
    """(node, component): every node of ``edges`` (u, v) that is not the least of its component, and that least node.

    Each round is two joins of the edges with one row per node; the number of
    rounds grows with the logarithm of the longest path. Nodes can be of any type
    that has an order. The number of tasks follows the number of edges, so that the
    many small steps do not leave thousands of tiny files.
    """
    now = durable(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    parts = 1 + now.count() // rows_per_task
    now, state = now.coalesce(parts), None
    while True:
        now = durable(_stars(durable(_stars(now, True, parts).coalesce(parts)), False, parts).coalesce(parts))
        new = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if new == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        state = new
