"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.common import drop_table, stage_table


def connected_components(edges: DataFrame, rounds: int = 100) -> DataFrame:
    """(id, component) of every id in ``edges`` (a, b: long); the component is its smallest id.

    Each round links every id to the smallest id near it; large stars and small stars alternate until
    nothing changes, in a number of rounds that grows with the logarithm of a component's diameter; if ``rounds`` are not enough it raises an error.
    Minima are taken by aggregation and joined back, so that an id with many links is no hot task.
    """
    now = stage_table(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    last = None
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        after = stage_table(small.where("u <> v").distinct(), "edges")
        state = after.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first()
        drop_table(now)
        now = after
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components have not settled after {rounds} rounds")
    roots = now.groupBy("v").agg(F.lit(1)).select(F.col("v").alias("id"), F.col("v").alias("component"))
    return now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id").unionByName(roots)
