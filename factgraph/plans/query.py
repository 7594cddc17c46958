"""Point queries on a snapshot: symbol lookup and the neighbourhood packet of one symbol."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.functions import scalars as S


def find_symbol(symbols: DataFrame, selector: str) -> DataFrame:
    """The symbol of this id, else of this canonical name; among several names the smallest id."""
    hit = symbols.where((F.col("id") == selector) | (F.col("canonical_name") == selector))
    return hit.orderBy((F.col("id") == selector).desc(), "id").limit(1)


def _list(rows: DataFrame, key: str, order: list[str], out: str) -> DataFrame:
    """Per key its rows as an array in order; the key column is named __k."""
    ranked = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*rows.columns).alias("row"))
    return rows.groupBy(F.col(key).alias("__k")).agg(F.transform(F.array_sort(F.collect_list(ranked)), lambda x: x["row"]).alias(out))


def context_packet(tables: dict[str, DataFrame], root: DataFrame, contents: DataFrame | None = None, window: int = 8) -> DataFrame:
    """One row per root symbol: the symbol, its file, imports, outgoing and incoming edges, tests, and its source slice."""
    files, calls = tables["files"], tables["call_candidates"]
    ids = root.select("id", "file_id")
    near = lambda rows, key, of: rows.join(ids.select(F.col(of).alias(key)).distinct(), key, "left_semi")
    parts = [
        (_list(near(tables["imports"], "file_id", "file_id"), "file_id", ["source", "alias", "id"], "imports"), "file_id"),
        (_list(near(calls, "source_symbol_id", "id"), "source_symbol_id", ["order_index", "id"], "outgoing"), "id"),
        (_list(near(calls, "target_symbol_id", "id"), "target_symbol_id", ["order_index", "id"], "incoming"), "id"),
        (_list(near(tables["tests"], "file_id", "file_id"), "file_id", ["start_line", "name", "id"], "tests"), "file_id"),
    ]
    out = root.select("id", "file_id", F.struct(*root.columns).alias("symbol")).join(files.select(F.col("id").alias("file_id"), F.struct(*files.columns).alias("file")), "file_id", "left")
    for part, key in parts:
        out = out.join(part.withColumnRenamed("__k", key), key, "left")
    if contents is not None:
        body = contents.select("repository_id", F.col("path").alias("__p"), F.decode("content", "UTF-8").alias("__t"))
        out = out.join(body, (F.col("symbol.repository_id") == body["repository_id"]) & (F.col("symbol.file_path") == F.col("__p")), "left").drop(body["repository_id"])
        both = S.source_context(F.col("__t"), F.col("symbol.start_line"), F.col("symbol.end_line"), window)
        text = lambda part: F.coalesce(both[part], F.lit(""))
        out = out.withColumn("function_source", text("source")).withColumn("surrounding_context", text("context")).drop("__p", "__t")
    empty = {c: F.coalesce(c, F.array()) for c in ("imports", "outgoing", "incoming", "tests")}
    return out.withColumns(empty).drop("file_id")
