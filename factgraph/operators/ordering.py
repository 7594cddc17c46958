"""Ordinals inside a partition, tightest scopes and ordered neighbour lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordinal(rows: DataFrame, keys: list[str], order: list, out: str = "order_index") -> DataFrame:
    """0-based position of a row inside its key."""
    return rows.withColumn(out, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def tightest(rows: DataFrame, scopes: DataFrame, on: list[str], point: str, start: str, end: str, row_id: str, scope_id: str) -> DataFrame:
    """(row_id, scope_id) of the shortest scope that contains the row's point, of equal ones the smallest scope_id.

    An equi-join: a scope of length up to 2**k stands in the one or two cells of width 2**k that it touches, and
    a point looks up one cell for each k that occurs (64 at most). So a point meets scopes around it, not all of its key.
    """
    length = F.col(end) - F.col(start)
    sized = scopes.where(length >= 0).withColumn("__k", F.ceil(F.log2(length.cast("double") + 1)).cast("int"))
    kinds = sorted(r["__k"] for r in sized.select("__k").distinct().collect())  # one for each power of two
    cell = lambda c, k: F.floor(F.col(c) / F.pow(F.lit(2.0), k)).cast("long")
    placed = sized.withColumn("__cell", F.explode(F.sequence(cell(start, F.col("__k")), cell(end, F.col("__k")))))
    asked = rows.withColumn("__k", F.explode(F.array(*[F.lit(k) for k in kinds]).cast("array<int>"))).withColumn("__cell", cell(point, F.col("__k")))
    inside = asked.join(placed, [*on, "__k", "__cell"]).where((F.col(start) <= F.col(point)) & (F.col(point) <= F.col(end)))
    return inside.groupBy(row_id).agg(F.min_by(scope_id, F.struct(length, F.col(scope_id))).alias(scope_id))


def neighbours(edges: DataFrame, key: str, order: list[str], shown: Column, out: str) -> DataFrame:
    """(key, position, ``out``): the edges of each node in order, one row each. A node's edges are sorted, never gathered into one value, so that a hot node spills rather than fails."""
    return ordinal(edges.select(key, *order, shown.alias(out)), [key], [*order, out], "position").select(key, "position", out)
