"""Reference resolution: joins that resolve a key only when it has one owner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def unique_owners(rows: DataFrame, key: str, owner: str) -> DataFrame:
    """(key, owner) of the keys that belong to exactly one distinct owner; aggregated before any join, so hot keys stay small."""
    return rows.where(F.nullif(F.col(key), F.lit("")).isNotNull()).groupBy(key).agg(F.min(owner).alias(owner), F.max(owner).alias("__hi")).where(F.col(owner) == F.col("__hi")).drop("__hi")


def resolve_unique(references: DataFrame, rows: DataFrame, ref_key: str, key: str, owner: str, out: str) -> DataFrame:
    """Adds ``out``: the only owner of the referenced key, else null."""
    owners = unique_owners(rows, key, owner).select(F.col(key).alias("__key"), F.col(owner).alias(out))
    return references.join(owners, references[ref_key] == F.col("__key"), "left").drop("__key")


def two_stage(references: DataFrame, candidates: DataFrame, ref_id: str, on: list[str], first: str, second: str, name: str, others: str, target: str) -> DataFrame:
    """For each reference: distinct targets of the first stage, of either stage, and the resolved one.

    The first stage wants ``name`` of a candidate equal to ``first``, the second wants ``second`` among its array
    ``others``. A tie in the first stage stays ambiguous: the second adds to the first's hits, it does not replace
    them. Targets are counted per key before any reference meets them, so each lookup is one row per reference,
    however many references and candidates share a key; what both stages hit is counted once more and taken off.
    """
    spread = candidates.select(*on, F.col(name).alias("__n"), F.explode(F.array_distinct(others)).alias("__o"), target)
    count = lambda rows, keys, tag: rows.groupBy(*on, *keys).agg(F.count_distinct(target).alias(f"n_{tag}"), F.min(target).alias(f"t_{tag}"))
    out = references.select(ref_id, *on, F.col(first).alias("__n"), F.col(second).alias("__o"))
    out = out.join(count(candidates.select(*on, F.col(name).alias("__n"), target), ["__n"], "first"), [*on, "__n"], "left")
    out = out.join(count(spread, ["__o"], "second"), [*on, "__o"], "left")
    out = out.join(count(spread, ["__n", "__o"], "both").drop("t_both"), [*on, "__n", "__o"], "left")
    n = {k: F.coalesce(f"n_{k}", F.lit(0).cast("long")) for k in ("first", "second", "both")}
    out = out.select(ref_id, n["first"].alias("n_first"), "t_first", (n["first"] + n["second"] - n["both"]).alias("n_all"), F.least("t_first", "t_second").alias("t_all"))
    return out.withColumn("resolved", F.when(F.col("n_first") == 1, F.col("t_first")).when((F.col("n_first") == 0) & (F.col("n_all") == 1), F.col("t_all")))


def suffixes(c: Column) -> Column:
    """All non-empty endings of a string."""
    return F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substr(c, i))).otherwise(F.array().cast("array<string>"))


def back_fill(rows: DataFrame, column: str, source: DataFrame, key: str, source_key: str, value: str) -> DataFrame:
    """Fills empty ``column`` from ``source`` by key."""
    lookup = source.select(F.col(source_key).alias("__k"), F.col(value).alias("__v"))
    return rows.join(lookup, rows[key] == F.col("__k"), "left").withColumn(column, F.coalesce(F.nullif(F.col(column), F.lit("")), F.col("__v"), F.lit(""))).drop("__k", "__v")
