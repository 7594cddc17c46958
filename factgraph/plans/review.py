"""Reviewed traversal of the call graph, level by level."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from factgraph.functions import scalars as S
from factgraph.operators.graph import classify

#: The rationales of the deterministic reviewer.
RATIONALES = {"accepted": "target symbol is present in indexed facts", "rejected": "test edge excluded from runtime flow", "ambiguous": "candidate is unresolved and needs verification"}


def deterministic(edges: DataFrame) -> DataFrame:
    status = classify(F.col("relationship"), F.col("target_symbol_id"))
    why = F.when(status == "accepted", RATIONALES["accepted"]).when(status == "rejected", RATIONALES["rejected"]).otherwise(RATIONALES["ambiguous"])
    return edges.withColumn("status", status).withColumn("rationale", why)


def traverse(calls: DataFrame, symbols: DataFrame, root: DataFrame, reviewer: Callable[[DataFrame], DataFrame] = deterministic, max_depth: int = 3, max_steps: int = 80) -> DataFrame:
    """Steps of a bounded breadth-first review, in order.

    Nodes at depth 0 to ``max_depth`` are expanded, each once; edges to visited nodes are still steps, so a
    cycle edge is kept once. Steps are ordered by (depth, position of the node, order_index, id), and the
    first ``max_steps`` count; since what follows the cap is never expanded, each level holds at most
    ``max_steps`` nodes, and its join reads edges of those nodes only. A reviewer may add notes and error, which
    then stand in the first step of a node; an accepted symbol that is not known is ambiguous, with a note.
    """
    edges = calls.select(F.col("id").alias("call_id"), F.col("source_symbol_id").alias("node"), "target_symbol_id", "target_canonical_name", "relationship", "evidence_source", "order_index")
    frontier = root.select(F.col("id").alias("node"), F.lit(0).alias("position"))
    seen = frontier.select("node")
    levels: list[DataFrame] = []
    left = max_steps
    for depth in range(max_depth + 1):
        met = reviewer(F.broadcast(frontier).join(edges, "node").withColumn("depth", F.lit(depth)))  # at most max_steps nodes
        for column, kind in (("notes", "array<string>"), ("error", "string")):
            met = met if column in met.columns else met.withColumn(column, F.lit(None).cast(kind))
        met = met.select("call_id", "node", "position", "target_symbol_id", "target_canonical_name", "evidence_source", "order_index", "status", "rationale", "notes", "error")
        known = symbols.select(F.col("id").alias("target_symbol_id"), F.col("canonical_name").alias("__c"))
        met = met.join(known, "target_symbol_id", "left")
        lost = (F.col("status") == "accepted") & F.col("__c").isNull()
        met = met.withColumn("notes", F.when(lost & (F.coalesce("target_symbol_id", F.lit("")) != ""), F.array_append(F.coalesce("notes", F.array().cast("array<string>")), F.concat(F.lit("failed to load symbol "), F.col("target_symbol_id")))).otherwise(F.col("notes")))
        status = F.when(lost, "ambiguous").otherwise(F.col("status"))
        met = met.withColumn("status", status).withColumn("to_canonical_name", F.coalesce("__c", "target_canonical_name"))
        met = met.withColumn("to_symbol_id", F.when(status == "ambiguous", "").otherwise(F.col("target_symbol_id"))).drop("__c")
        first = met.orderBy("position", "order_index", "call_id").limit(left)
        n = F.row_number().over(Window.orderBy("position", "order_index", "call_id"))
        steps = first.withColumn("depth", F.lit(depth)).withColumn("n", n)
        rows = steps.collect()  # max_steps rows at most
        if not rows:
            break
        spark = calls.sparkSession
        levels.append(spark.createDataFrame(rows, steps.schema))
        left -= len(rows)
        nodes: dict[str, int] = {}
        for r in rows:
            if r["status"] == "accepted":
                nodes.setdefault(r["to_symbol_id"], len(nodes))
        if not nodes or left <= 0:
            break
        frontier = spark.createDataFrame(list(nodes.items()), "node string, position int").join(seen, "node", "left_anti")
        seen = seen.unionByName(frontier.select("node"))
    out = None
    for level in levels:
        out = level if out is None else out.unionByName(level)
    columns = ["step", "id", "depth", "from_symbol_id", "from_canonical_name", "to_symbol_id", "to_canonical_name", "status", "rationale", "evidence", "notes", "error"]
    if out is None:
        return calls.sparkSession.createDataFrame([], "step int, id string, depth int, from_symbol_id string, from_canonical_name string, to_symbol_id string, to_canonical_name string, status string, rationale string, evidence string, notes array<string>, error string")
    names = symbols.select(F.col("id").alias("node"), F.col("canonical_name").alias("from_canonical_name"))
    out = out.withColumn("step", F.row_number().over(Window.orderBy("depth", "n"))).join(names, "node", "left").withColumnRenamed("node", "from_symbol_id").withColumnRenamed("evidence_source", "evidence")
    return out.withColumn("id", S.stable_id("review", F.lit("step"), F.col("from_symbol_id"), F.col("to_symbol_id"), F.col("to_canonical_name"), F.col("step"))).select(*columns)


def summary(steps: DataFrame) -> DataFrame:
    return steps.groupBy("status").agg(F.count("*").alias("steps"))
