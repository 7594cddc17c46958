"""Schemas of the raw facts that parsers give for a file, and names of the stored fact tables."""

from __future__ import annotations

PLACE = "start_line: bigint, start_col: bigint, end_line: bigint, end_col: bigint, start_byte: bigint, end_byte: bigint"
RAW = {
    "symbols": f"name: string, receiver: string, canonical_name: string, kind: string, signature: string, synthetic: boolean, {PLACE}",
    "imports": "source: string, alias: string, imported_name: string, export_name: string, is_default: boolean, is_namespace: boolean, candidates: array<string>",
    "exports": "name: string, canonical_name: string, is_default: boolean",
    "calls": "symbol: int, order_index: int, evidence: string, form: string, operand: string, name: string, owner: string",
    "hints": "symbol: int, target: int, target_symbol: string, kind: string, evidence: string, order_index: int",
    "fields": "struct: string, field: string, token: string",
}
FACT_TABLES = ["index_runs", "repositories", "services", "files", "symbols", "imports", "exports", "call_candidates", "execution_hints", "diagnostics", "tests", "boundaries"]
#: Columns by which a table is looked up; rows of a file are sorted by them, for skipping by minimum and maximum.
LOOKUP = {"symbols": ["canonical_name"], "imports": ["file_id"], "call_candidates": ["source_symbol_id"], "tests": ["file_id"]}


def raw_schema() -> str:
    return "repository_id string, path string, language string, package string, " + ", ".join(f"{k} array<struct<{v}>>" for k, v in RAW.items())
