"""Validation of tasks, context packets and reviewer answers: ordered arrays of issues."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from factgraph.functions.scalars import trim_all

TASK_ID = "^[A-Za-z0-9][A-Za-z0-9._-]*$"
STATUSES = ("accepted", "ambiguous", "rejected")
#: Code, message and source of each issue; {} is the position of the input or slice.
TASK_ISSUES = {
    "id": ("task_id_required", "task ID is required", "task.id"),
    "id_form": ("task_id_invalid", "task ID must start with an alphanumeric character", "task.id"),
    "role": ("task_role_required", "task role is required", "task.role"),
    "output_dir": ("task_output_dir_required", "task output directory is required", "task.output_dir"),
    "artifact_type": ("artifact_type_required", "input artifact type is required", "task.input_artifacts[{}].type"),
    "artifact_path": ("artifact_path_required", "input artifact path is required", "task.input_artifacts[{}].path"),
}
PACKET_ISSUES = {
    "task_id": ("context_task_id_required", "context task_id is required", "context.task_id"),
    "role": ("context_role_required", "context role is required", "context.role"),
    "goal": ("context_goal_required", "context goal is required", "context.goal"),
    "output_schema": ("context_output_schema_required", "context output_schema is required", "context.output_schema"),
    "input_type": ("context_input_type_required", "context input type is required", "context.inputs[{}].type"),
    "ref_type": ("context_input_ref_type_required", "context input ref type is required", "context.inputs[{}].ref.type"),
    "ref_path": ("context_input_ref_path_required", "context input ref path is required", "context.inputs[{}].ref.path"),
    "file_path": ("source_slice_file_path_required", "source slice file_path is required", "context.source_slices[{}].file_path"),
    "start_line": ("source_slice_start_line_invalid", "source slice start_line must be greater than 0", "context.source_slices[{}].start_line"),
    "end_line": ("source_slice_end_line_invalid", "source slice end_line must be greater than or equal to start_line", "context.source_slices[{}].end_line"),
}


def issue(entry: tuple[str, str, str], position: Column | None = None) -> Column:
    code, message, source = entry
    before, _, after = source.partition("{}")
    where = F.lit(source) if position is None else F.concat(F.lit(before), position.cast("string"), F.lit(after))
    return F.struct(F.lit(code).alias("code"), F.lit(message).alias("message"), F.lit("error").alias("severity"), where.alias("source"))


def empty(c: Column) -> Column:
    return F.coalesce(c, F.lit("")) == ""


def blank(c: Column) -> Column:
    return trim_all(F.coalesce(c, F.lit(""))) == ""


def task_issues(id_: Column, role: Column, output_dir: Column, artifacts: Column | None = None) -> Column:
    """Issues of a task in a fixed order; ``artifacts`` is array<struct<type, path>>. Only empty values are missing, blanks are not."""
    t = TASK_ISSUES
    checks = F.array(
        F.when(empty(id_), issue(t["id"])).when(~F.regexp_like(id_, F.lit(TASK_ID)), issue(t["id_form"])),
        F.when(empty(role), issue(t["role"])),
        F.when(empty(output_dir), issue(t["output_dir"])),
    )
    if artifacts is not None:
        each = F.transform(artifacts, lambda a, i: F.when(empty(a["type"]), issue(t["artifact_type"], i)).when(empty(a["path"]), issue(t["artifact_path"], i)))
        checks = F.concat(checks, F.coalesce(each, F.array()))
    return F.filter(checks, lambda x: x.isNotNull())


def packet_issues(task_id: Column, role: Column, goal: Column, output_schema: Column, inputs: Column, slices: Column) -> Column:
    """Issues of a context packet: four scalars, then three checks for each input and each source slice. Blanks are missing here."""
    t = PACKET_ISSUES
    scalars = F.array(*[F.when(blank(c), issue(t[n])) for n, c in (("task_id", task_id), ("role", role), ("goal", goal), ("output_schema", output_schema))])
    of_input = F.transform(inputs, lambda x, i: F.array(F.when(blank(x["type"]), issue(t["input_type"], i)), F.when(blank(x["ref"]["type"]), issue(t["ref_type"], i)), F.when(blank(x["ref"]["path"]), issue(t["ref_path"], i))))
    of_slice = F.transform(slices, lambda x, i: F.array(F.when(blank(x["file_path"]), issue(t["file_path"], i)), F.when(x["start_line"] <= 0, issue(t["start_line"], i)), F.when(x["end_line"] < x["start_line"], issue(t["end_line"], i))))
    return F.filter(F.concat(scalars, F.coalesce(F.flatten(of_input), F.array()), F.coalesce(F.flatten(of_slice), F.array())), lambda x: x.isNotNull())


def parse_response(text: str) -> dict:
    """Strict decoding of a reviewer's answer: unknown keys, trailing data, no decision, unknown status or missing target raise ValueError."""
    value = json.loads(text)
    if not isinstance(value, dict) or set(value) - {"decisions", "notes"}:
        raise ValueError("unknown field in response")
    decisions = value.get("decisions") or []
    if not decisions:
        raise ValueError("response has no decision")
    for d in decisions:
        if not isinstance(d, dict) or set(d) - {"target_symbol_id", "target_canonical_name", "status", "rationale"}:
            raise ValueError("unknown field in decision")
        if d.get("status") not in STATUSES:
            raise ValueError(f"unknown status {d.get('status')!r}")
        if not (d.get("target_symbol_id") or "").strip() and not (d.get("target_canonical_name") or "").strip():
            raise ValueError("decision without target")
    return {"decisions": decisions, "notes": value.get("notes") or []}
