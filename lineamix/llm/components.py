"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lineamix.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """Rows (node, component): every node of an edge with the smallest node it can reach.

    ``edges`` has columns ``a`` and ``b`` of one ordered type; direction, repeats, loops and rows
    with a NULL end have no effect beyond making their known ends nodes (a loop makes a component
    of one). Each step is a map-side combined minimum and an equi-join whose skewed side Spark can
    split, so that a hub with a third of all edges is not one task. The edges of each step are
    written to the shared folder: recovery does not replay earlier steps.
    """
    nodes = edges.select("a").union(edges.select(F.col("b").alias("a"))).where("a IS NOT NULL")
    current = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = written(current.distinct(), "edges")
    while not _is_star(current):
        current = written(_small_star(_large_star(current)), "edges")
    centres = current.groupBy("a").agg(F.min("b").alias("b"))
    return (
        nodes.distinct()
        .join(centres, "a", "left")
        .select(F.col("a").alias("node"), F.coalesce("b", "a").alias("component"))
    )


def _is_star(edges: DataFrame) -> bool:
    """True when no smaller end is the larger end of another edge and each larger end has one edge."""
    ends = edges.select("a", F.lit(1).alias("up"), F.lit(0).alias("down")).union(
        edges.select("b", F.lit(0), F.lit(1))
    )
    roles = ends.groupBy("a").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return roles.where("up > 1 OR (up > 0 AND down > 0)").isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node next to it."""
    both = edges.union(edges.select("b", "a"))
    least = both.groupBy("a").agg(F.min("b").alias("m"))
    # The larger neighbours of u are the edges (v, u) in which u is the smaller end.
    return (
        edges.join(least.withColumnRenamed("a", "b"), "b")
        .select("a", F.least("b", "m").alias("b"))
        .distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    smaller = edges.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return smaller.union(least.select("a", F.col("m").alias("b"))).distinct()
