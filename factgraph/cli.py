"""Commands: scan, index, inspect-function, review-flow, export-md, export-mermaid, export-graphjson."""

from __future__ import annotations

import argparse
import datetime
import hashlib
import json
import re
import sys
from pathlib import Path
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.functions import scalars as S
from factgraph.plans import export, index, query, review, reviewer
from factgraph.progress import Reporter
from factgraph.schemas import FACT_TABLES
from factgraph.settings import Settings
from factgraph.sources import scan, store
from factgraph.sources.artifacts import ArtifactStore


def digest(*parts: str) -> str:
    return hashlib.sha1(b"".join(p.strip().encode() + bytes(1) for p in parts)).hexdigest()[:12]


def workspace_id(path: str) -> str:
    base = re.sub("[^a-z0-9]+", "_", Path(path).name.lower()).strip("_") or "workspace"
    return f"ws_{base}_{digest(path)}"


def snapshot_id(workspace: str, now: datetime.datetime) -> str:
    return f"{workspace}_{now:%Y%m%dT%H%M%SZ}"


def rows(df: DataFrame) -> list[dict]:
    return [json.loads(x) for x in df.toJSON().collect()]


def moment(now: datetime.datetime) -> str:
    return now.astimezone(datetime.UTC).isoformat().replace("+00:00", "Z")


def scan_result(spark: SparkSession, workspace: str, ignore: str, store_root: str, progress: Reporter) -> tuple[dict, DataFrame]:
    """What a scan finds, with its four artifacts written, and the files that it admits."""
    path = str(Path(workspace).resolve())
    policy, ws = scan.IgnorePolicy(ignore.split(",")), workspace_id(path)
    progress.start("scan", status=path)
    listing, warnings = scan.list_workspace(spark, path), []
    admitted = listing.where(~policy.ignores(F.col("relative_path")))
    skipped = scan.skipped(listing, policy).count()
    files = scan.read_workspace(spark, path, policy)
    placed = scan.assign_repository(files, scan.repository_roots(files))
    found = rows(scan.services(placed).join(index.boundary_hints(placed), "root", "left").select(S.stable_id("svc", F.col("root"), F.col("service_root"), F.col("name")).alias("id"), index.repository_id().alias("repository_id"), "name", F.col("service_root").alias("root_path"), "entrypoints", F.col("boundary_hints").alias("boundaries")))
    services = sorted({x["id"]: x for x in found}.values(), key=lambda x: (x["repository_id"], x["root_path"], x["name"]))  # the last of an id
    repositories = sorted(rows(index.repositories(placed)), key=lambda x: x["root_path"])
    plans = sorted(rows(scan.extraction_plans(placed).select(index.repository_id().alias("repository_id"), "language", "files")), key=lambda x: (x["repository_id"], x["language"]))
    counts = {"skipped_ignored_files": skipped, "files": admitted.count()}
    for r in repositories:
        r["candidate_services"] = [x["id"] for x in services if x["repository_id"] == r["id"]]
    manifest = {"id": ws, "root_path": path, "ignore_signature": policy.signature, "repository_ids": sorted(r["id"] for r in repositories), "languages": sorted({x for r in repositories for x in r["languages"]}), "warnings": warnings, "scanned_at": moment(datetime.datetime.now(datetime.UTC))}
    artifacts = ArtifactStore(store_root)
    saved = [("workspace_manifest", manifest), ("repository_manifests", repositories), ("service_manifests", services), ("scan_warnings", warnings)]
    refs = [artifacts.save_json(ws, "", f"{kind}.json", kind, value) for kind, value in saved]
    progress.finish(f"repos={len(repositories)} warnings={len(warnings)}")
    inventory = {"workspace_id": ws, "ignore_signature": policy.signature, "issue_counts": counts, "repositories": repositories, "plans": plans}
    return {"workspace_manifest": manifest, "inventory": inventory, "service_manifests": services, "artifact_refs": refs, "warnings": warnings}, files


def run_index(args: argparse.Namespace, spark: SparkSession, progress: Reporter) -> dict:
    scanned, files = scan_result(spark, args.workspace, args.ignore, args.store, progress)
    manifest, now = scanned["workspace_manifest"], datetime.datetime.now(datetime.UTC)
    ws, snap = manifest["id"], snapshot_id(manifest["id"], now)
    progress.start("index", len(FACT_TABLES))
    built = index.index_workspace(files, now.isoformat(), manifest["root_path"], scanned["inventory"]["issue_counts"]["skipped_ignored_files"])
    store.save(built.tables, args.store, ws, snap)
    tables = {t: store.load(spark, args.store, t, ws, snap) for t in FACT_TABLES}
    paths = store.save_json(tables, args.store, ws, snap)
    counts = rows(tables["index_runs"])[0]
    ref = ArtifactStore(args.store).save_json(ws, snap, "facts/facts_index.json", "facts_index", {"workspace_id": ws, "snapshot_id": snap, "generated_at": moment(now), **{k: v for k, v in counts.items() if k != "generated_at"}, "tables": paths})
    progress.finish(f"symbols={counts['symbol_count']}")
    return {"workspace_id": ws, "snapshot_id": snap, "jsonl": {"index_path": ref["path"], **{f"{t}_path": x for t, x in paths.items()}}, "counts": counts, "artifact_refs": [*scanned["artifact_refs"], ref]}


def contents(spark: SparkSession, root: DataFrame, files: DataFrame) -> DataFrame:
    """(repository_id, path, content) of the root symbol's file; no row where it can't be read."""
    schema = "repository_id string, path string, content binary"
    at = root.join(files.select(F.col("id").alias("file_id"), "absolute_path"), "file_id").select("repository_id", "file_path", "absolute_path").first()
    try:
        body = spark.read.format("binaryFile").load(at["absolute_path"]).select("content").first() if at else None
    except AnalysisException:  # the file is gone
        body = None
    return spark.createDataFrame([(at["repository_id"], at["file_path"], body["content"])] if body else [], schema)


def run_review(args: argparse.Namespace, spark: SparkSession, tables: dict[str, DataFrame], root: DataFrame, settings: Settings) -> dict:
    client = reviewer.RemoteReviewer(settings.reviewer_url, settings.reviewer_model, settings.reviewer_key, settings.reviewer_timeout, settings.reviewer_retries) if settings.reviewer_url and settings.reviewer_model else None
    judge = reviewer.by_node(client) if client else review.deterministic
    depth, most = args.max_depth if args.max_depth > 0 else 3, args.max_steps if args.max_steps > 0 else 80
    found = sorted(rows(review.traverse(tables["call_candidates"], tables["symbols"], root, judge, depth, most)), key=lambda s: s["step"])
    first, now = rows(root)[0], moment(datetime.datetime.now(datetime.UTC))
    notes, failed = [], None
    for x in found:
        given, error = x.pop("notes", None) or [], x.pop("error", "")
        if error:
            notes.append(f"review failed for {x['from_canonical_name']}: {error}")
            failed = {"workspace_id": args.workspace_id, "snapshot_id": args.snapshot_id, "symbol_id": x["from_symbol_id"], "symbol": x["from_canonical_name"], "depth": x["depth"], "error": error, "created_at": now}
        notes += given
    by = {s: [x for x in found if x["status"] == s] for s in ("accepted", "ambiguous", "rejected")}
    id_ = "review_" + digest(args.workspace_id, args.snapshot_id, first["id"], now)
    flow = {"id": id_, "workspace_id": args.workspace_id, "snapshot_id": args.snapshot_id, "root_symbol_id": first["id"], "root_canonical_name": first["canonical_name"], "created_at": now, "steps": found, **by, "uncertainty_notes": notes}
    store.save_flow(spark, args.store, flow)
    out = Path(args.out) if args.out else ArtifactStore(args.store).path_for(args.workspace_id, args.snapshot_id, "review")
    out.mkdir(parents=True, exist_ok=True)
    written = {"flow_path": ("flow.json", json.dumps(flow, indent=2)), "evidence_path": ("evidence.json", json.dumps(found, indent=2)), "uncertainty_md": ("uncertainty.md", "\n".join(notes))}
    if failed:
        written["error_path"] = ("llm_error.json", json.dumps(failed, indent=2))
    for name, body in written.values():
        (out / name).write_text(body)
    return {"flow": flow, **{k: str(out / name) for k, (name, _) in written.items()}}


def run(args: argparse.Namespace, spark: SparkSession, settings: Settings | None = None) -> Any:
    settings = settings or Settings.read()
    if args.command in ("scan", "index"):
        progress = Reporter(args.progress_mode)
        return scan_result(spark, args.workspace, args.ignore, args.store, progress)[0] if args.command == "scan" else run_index(args, spark, progress)
    if args.command in ("inspect-function", "review-flow"):
        tables = {t: store.load(spark, args.store, t, args.workspace_id, args.snapshot_id) for t in FACT_TABLES}
        root = query.find_symbol(tables["symbols"], args.symbol)
        if root.isEmpty():
            raise SystemExit(f"symbol not found: {args.symbol}")
        if args.command == "inspect-function":
            return rows(query.context_packet(tables, root, contents(spark, root, tables["files"]), args.context_window))[0]
        return run_review(args, spark, tables, root, settings)
    flow = json.loads(Path(args.review).read_text())
    root, steps = flow["root_canonical_name"], flow["steps"]
    text = {"export-md": lambda: export.markdown(root, steps, flow.get("uncertainty_notes") or [], flow.get("id", "")), "export-mermaid": lambda: export.mermaid(root, steps), "export-graphjson": lambda: json.dumps(export.graph_json(flow["root_symbol_id"], root, steps), indent=2)}[args.command]()
    if not args.out:
        return text
    Path(args.out).write_text(text)
    return {"out": args.out}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="factgraph", description=__doc__)
    sub, settings = p.add_subparsers(dest="command", required=True), Settings.read()
    for name in ("scan", "index"):
        c = sub.add_parser(name)
        c.add_argument("--workspace", default=".")
        c.add_argument("--ignore", default="")
        c.add_argument("--progress-mode", default=settings.progress_mode, help="auto, tty, plain or quiet")
        c.add_argument("--store", default=settings.store)
    for name in ("inspect-function", "review-flow"):
        c = sub.add_parser(name)
        for flag in ("--workspace-id", "--snapshot-id", "--symbol"):
            c.add_argument(flag, required=True)
        c.add_argument("--store", default=settings.store)
        c.add_argument("--out", default="")
        c.add_argument("--context-window", type=int, default=8)
        c.add_argument("--max-depth", type=int, default=3)
        c.add_argument("--max-steps", type=int, default=80)
    for name in ("export-md", "export-mermaid", "export-graphjson"):
        c = sub.add_parser(name)
        c.add_argument("--review", required=True)
        c.add_argument("--out", default="")
    return p


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = None
    if not args.command.startswith("export"):
        spark = SparkSession.builder.appName("factgraph").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false").getOrCreate()
    result = run(args, spark)
    print(result if isinstance(result, str) else json.dumps(result, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
