"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kerbline.session import cut_lineage


def _with_lowest(edges: DataFrame) -> DataFrame:
    """Add to each directed edge (u, v) the lowest node of u and its neighbours."""
    lowest = edges.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
    return edges.join(lowest, "u")


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for edges ``(a, b)``; a component is named by its lowest node.

    Neighbours are linked to the lowest node in reach, above and below a node in turn, until
    every edge points at the lowest node of its component. Rounds grow with the logarithm of
    the size of a component; each is two grouped joins, written to the shared folder.
    """
    current = edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    current = cut_lineage(current)
    signature = None
    while True:
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        upper = _with_lowest(both).filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        linked = _with_lowest(upper)
        lower = linked.select(F.col("v").alias("u"), F.col("low").alias("v")).unionByName(
            linked.select("u", F.col("low").alias("v"))
        )
        current = cut_lineage(lower.filter("u <> v").distinct())
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == signature:
            break
        signature = state
    roots = current.select(F.col("v").alias("node")).distinct()
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
