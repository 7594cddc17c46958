"""Bounded breadth-first traversal and edge classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factgraph.operators.staging import staged


def bfs_levels(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(node, depth) at least distance, to ``depth`` at most.

    ``edges`` has src and dst, ``roots`` has node. Each level is one join over the nodes met first at the level
    before; it is staged, so that no level is computed twice, and nodes met before are taken out of it.
    """
    frontier = staged(roots.select("node").where("node is not null").distinct().withColumn("depth", F.lit(0)), "level")
    visited = frontier
    for d in range(1, depth + 1):
        met = frontier.select(F.col("node").alias("src")).join(edges, "src").select(F.col("dst").alias("node")).where("node is not null").distinct()
        frontier = staged(met.join(visited.select("node"), "node", "left_anti").withColumn("depth", F.lit(d)), "level")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def classify(relationship: Column, target: Column) -> Column:
    """The deterministic reviewer: test edges are rejected, edges with a target accepted, others ambiguous."""
    return F.when(F.lower(relationship) == "test", "rejected").when(F.coalesce(target.cast("string"), F.lit("")) != "", "accepted").otherwise("ambiguous")


def node_set(edges: DataFrame, root: DataFrame | None = None) -> DataFrame:
    """Distinct endpoints (id, label) of accepted edges; the label met first, by ordinal, wins."""
    ends = edges.select(F.col("src").alias("id"), F.col("src_label").alias("label"), (F.col("ordinal") * 2).alias("o")).unionByName(edges.select(F.col("dst").alias("id"), F.col("dst_label").alias("label"), (F.col("ordinal") * 2 + 1).alias("o")))
    if root is not None:
        ends = ends.unionByName(root.select("id", "label", F.lit(-1).cast("long").alias("o")))
    return ends.groupBy("id").agg(F.min_by("label", F.struct("o", "label")).alias("label"))
