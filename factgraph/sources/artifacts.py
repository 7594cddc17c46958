"""Small artifacts of a workspace or a snapshot, written by the driver: indented JSON or text, each with a typed reference."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

#: Kinds of artifacts.
KINDS = {"workspace_manifest", "repository_manifests", "service_manifests", "scan_warnings", "facts_index", "review_flow", "review_markdown", "mermaid_diagram"}


class ArtifactStore:
    def __init__(self, root: str):
        self.root = Path(root)

    def path_for(self, workspace_id: str, snapshot_id: str, name: str) -> Path:
        base = self.root / "workspaces" / workspace_id
        return base / "snapshots" / snapshot_id / name if snapshot_id else base / name

    def save_text(self, workspace_id: str, snapshot_id: str, name: str, kind: str, body: str) -> dict[str, str]:
        if kind not in KINDS:
            raise ValueError(f"unknown kind of artifact: {kind}")
        path = self.path_for(workspace_id, snapshot_id, name)
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(body)
        return {"type": kind, "workspace_id": workspace_id, "snapshot_id": snapshot_id, "path": str(path)}

    def save_json(self, workspace_id: str, snapshot_id: str, name: str, kind: str, payload: Any) -> dict[str, str]:
        return self.save_text(workspace_id, snapshot_id, name, kind, json.dumps(payload, indent=2, ensure_ascii=False))
