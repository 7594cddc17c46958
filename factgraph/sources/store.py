"""Snapshots of fact tables: Parquet partitioned by workspace and snapshot, and JSON lines."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgraph.operators.dedup import last_wins
from factgraph.schemas import FACT_TABLES, LOOKUP


def save(tables: dict[str, DataFrame], root: str, workspace_id: str, snapshot_id: str) -> None:
    """Replaces the snapshot's partition of every table; of rows with one id the last stays, others untouched."""
    for name, rows in tables.items():
        if "id" in rows.columns:
            rows = last_wins(rows, ["id"], [c for c in rows.columns if c != "id" and not dict(rows.dtypes)[c].startswith("map")])
        keyed = rows.withColumn("workspace_id", F.lit(workspace_id)).withColumn("snapshot_id", F.lit(snapshot_id))
        if by := LOOKUP.get(name):
            keyed = keyed.sortWithinPartitions(*by)
        rows.limit(0).coalesce(1).write.mode("overwrite").parquet(f"{root}/schemas/{name}")
        keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("workspace_id", "snapshot_id").parquet(f"{root}/facts/{name}")


def load(spark: SparkSession, root: str, name: str, workspace_id: str, snapshot_id: str) -> DataFrame:
    """One table of a snapshot; the filter on the partition columns prunes all other snapshots."""
    schema = spark.read.parquet(f"{root}/schemas/{name}").schema
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/facts/{name}")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("workspace_id", T.StringType()), T.StructField("snapshot_id", T.StringType())])).parquet(f"{root}/facts/{name}")
    return rows.where((F.col("workspace_id") == workspace_id) & (F.col("snapshot_id") == snapshot_id)).drop("workspace_id", "snapshot_id")


def delete(spark: SparkSession, root: str, names: list[str], workspace_id: str, snapshot_id: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for name in names:
        path = jvm.org.apache.hadoop.fs.Path(f"{root}/facts/{name}/workspace_id={workspace_id}/snapshot_id={snapshot_id}")
        path.getFileSystem(conf).delete(path, True)


def json_paths(root: str, workspace_id: str, snapshot_id: str) -> dict[str, str]:
    base = f"{root}/workspaces/{workspace_id}/snapshots/{snapshot_id}/facts"
    return {t: f"{base}/facts_{t}.jsonl" for t in FACT_TABLES if t != "index_runs"}


def save_json(tables: dict[str, DataFrame], root: str, workspace_id: str, snapshot_id: str) -> dict[str, str]:
    """JSON lines of every table, each a folder of part files in order of id; empty values are left out. Gives the paths."""
    paths = json_paths(root, workspace_id, snapshot_id)
    for name, path in paths.items():
        rows = tables[name]
        kept = [F.nullif(F.col(c), F.lit("")).alias(c) if t == "string" else F.col(c) for c, t in rows.dtypes]
        rows.orderBy("id").select(*kept).write.mode("overwrite").option("ignoreNullFields", "true").json(path)
    return paths


FLOW = "id string, root_symbol_id string, root_canonical_name string, created_at string, body string"


def save_flow(spark: SparkSession, root: str, flow: dict) -> None:
    """Inserts a review flow, or replaces the one of its id."""
    row = spark.createDataFrame([(flow["id"], flow["root_symbol_id"], flow["root_canonical_name"], flow["created_at"], json.dumps(flow))], FLOW)
    row = row.withColumn("workspace_id", F.lit(flow["workspace_id"])).withColumn("snapshot_id", F.lit(flow["snapshot_id"])).withColumn("flow_id", F.lit(flow["id"]))
    row.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("workspace_id", "snapshot_id", "flow_id").parquet(f"{root}/facts/review_flows")


def load_flow(spark: SparkSession, root: str, workspace_id: str, snapshot_id: str, flow_id: str) -> dict | None:
    """The review flow of an id; only its partition is read."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/facts/review_flows")
    if not path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        return None
    schema = f"{FLOW}, workspace_id string, snapshot_id string, flow_id string"
    hit = spark.read.schema(schema).parquet(f"{root}/facts/review_flows").where((F.col("workspace_id") == workspace_id) & (F.col("snapshot_id") == snapshot_id) & (F.col("flow_id") == flow_id)).select("body").first()
    return json.loads(hit["body"]) if hit else None
