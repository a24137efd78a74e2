"""Connected components of a link table by alternating large and small stars, all in DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from joinlift.llm.common import store


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Large: every neighbour above a node moves to the node's smallest neighbour. Small: those below it do."""
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    near = down.unionByName(down.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else down
    # the minimum is combined before the shuffle; the join splits a hub's partition when it is large
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(
            least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node above (``a``) has one node below it (``b``), which is below none: the smallest of its component."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("above"), F.lit(0).alias("below")).unionByName(
        edges.select(F.col("b").alias("node"), F.lit(0).alias("above"), F.lit(1).alias("below")))
    roles = ends.groupBy("node").agg(F.sum("above").alias("above"), F.max("below").alias("below"))
    return roles.where("above + below > 1").isEmpty()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node that each linked node reaches. Nodes without links are left out.

    Each star's links are a table in the shared folder, so lineage and plans stay short; the number of rounds grows with the
    logarithm of the number of nodes. Self links and repeated links do no harm; no links give an empty table.
    """
    edges = store(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a <> b").distinct())
    while not _are_stars(edges):
        edges = store(_star(store(_star(edges, large=True)), large=False))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
