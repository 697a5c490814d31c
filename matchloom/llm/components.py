"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import drop_path, growing, shared_dir, stored

#: A node with more than this part (1/HUB_SHARE) of all edges, and HUB_LEAST of them, is a hub.
HUB_SHARE, HUB_LEAST = 1024, 1000


def _star(edges: DataFrame, large: bool, total: int) -> DataFrame:
    """One step over `total` edges (a, b) with a > b: link each node's neighbours to its least neighbour.

    A hub's neighbours learn its least one from a broadcast, which has 2 * HUB_SHARE rows at most
    whatever the input, so that no task gathers them; those of other nodes by a join.
    """
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), (F.col("n") > max(HUB_LEAST, total // HUB_SHARE)).alias("hub"))
    hubs = F.broadcast(least.where("hub").select("a", "m"))
    joined = both.join(hubs, "a").unionByName(both.join(hubs, "a", "left_anti").join(growing(least.where("not hub").select("a", "m")), "a"))
    if large:
        out = joined.where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select("a", F.col("m").alias("b")))
    return out.where("a > b").distinct()


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node has one edge to a smaller one or only edges to larger ones."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1")
    return odd.limit(1).count() == 0


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); component is the least node that links reach.

    Each step is written to the shared folder; the loop ends when the edges are stars round their
    least nodes, which is then their components. No links give no rows; links of a node to itself
    and repeated links change nothing.
    """
    spark = links.sparkSession
    folder = shared_dir(spark, "components")
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), f"{folder}/0")
    step = 0
    while not _are_stars(edges):
        step, total = step + 1, edges.count()
        half = stored(_star(edges, True, total), f"{folder}/{step}-large")
        edges = stored(_star(half, False, half.count()), f"{folder}/{step}")
        drop_path(spark, f"{folder}/{step}-large")
        drop_path(spark, f"{folder}/{step - 1}")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component"))).distinct()
