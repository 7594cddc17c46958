"""Renderings of a reviewed flow: Markdown, sequence diagram and graph JSON. A flow has a bounded number of steps."""

from __future__ import annotations

from collections import Counter
from typing import Any


def short(name: str) -> str:
    return name if name.endswith("/") else name.rsplit("/", 1)[-1]


def rolling_hash(text: str) -> str:
    h = 5381
    for b in text.encode():
        h = ((h << 5) ^ h ^ b) & 0xFFFFFFFF
    return format(h % 0xFFFFFFFF, "x")


def key_of(id_: str, canonical: str) -> str:
    return id_ if id_ and len(id_.encode()) <= 64 else f"{canonical}_{rolling_hash(canonical)}"


#: Fixed value: what stands for a blank rationale.
NO_RATIONALE = "no rationale provided"


def markdown(root: str, steps: list[dict[str, Any]], notes: list[str], id_: str = "") -> str:
    counts = Counter(s["status"] for s in steps)
    lines = ["# Flow Review", "", f"- root: `{root}`", f"- review_id: `{id_}`", *(f"- {k}: `{counts[k]}`" for k in ("accepted", "ambiguous", "rejected")), "", "## Accepted Steps", ""]
    lines += [f"- `{s['from_canonical_name']}` -> `{s['to_canonical_name']}`: {(s.get('rationale') or '').strip() or NO_RATIONALE}" for s in steps if s["status"] == "accepted"] or ["- none"]
    if notes:
        lines += ["", "## Uncertainty Notes", "", *(f"- {n}" for n in notes)]
    return "\n".join(lines) + "\n\n"


def label_of(canonical: str) -> str:
    return canonical.rsplit(".", 1)[-1].translate(str.maketrans("-/: ", "____"))


def quoted(text: str) -> str:
    return '"' + text.replace('"', "'") + '"' if any(c in text for c in " \t:>") else text


def mermaid(root: str, steps: list[dict[str, Any]]) -> str:
    accepted = [s for s in steps if s["status"] == "accepted"]
    names = {key_of("", root) if not accepted else key_of(accepted[0]["from_symbol_id"], accepted[0]["from_canonical_name"]): root}
    for s in accepted:
        names.setdefault(key_of(s["from_symbol_id"], s["from_canonical_name"]), s["from_canonical_name"])
        names.setdefault(key_of(s["to_symbol_id"], s["to_canonical_name"]), s["to_canonical_name"])
    shared = Counter(label_of(n) for n in names.values())
    labels = {k: label_of(n) if shared[label_of(n)] == 1 else f"{label_of(n)}_{k[-6:]}" for k, n in names.items()}
    lines = ["sequenceDiagram", *(f"    participant {x}" for x in sorted(labels.values()))]
    for s in accepted:
        a, b = labels[key_of(s["from_symbol_id"], s["from_canonical_name"])], labels[key_of(s["to_symbol_id"], s["to_canonical_name"])]
        lines.append(f"    {a}->>{b}: {quoted((s.get('rationale') or '').strip() or 'calls')}")
    return "\n".join(lines) + "\n"


def graph_json(root_id: str, root: str, steps: list[dict[str, Any]]) -> dict[str, Any]:
    nodes = {key_of(root_id, root): short(root)}
    edges = []
    for s in steps:
        if s["status"] == "accepted":
            a, b = key_of(s["from_symbol_id"], s["from_canonical_name"]), key_of(s["to_symbol_id"], s["to_canonical_name"])
            nodes.setdefault(a, short(s["from_canonical_name"]))
            nodes.setdefault(b, short(s["to_canonical_name"]))
            edges.append({"source": a, "target": b, "label": (s.get("rationale") or "").strip() or "calls"})
    return {"nodes": [{"id": k, "label": nodes[k]} for k in sorted(nodes)], "edges": edges}
