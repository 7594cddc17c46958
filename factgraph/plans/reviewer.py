"""Reviewers that answer per symbol: the remote client, and the match of its decisions to candidates.

``by_node`` makes a reviewer of edges, as ``review.traverse`` wants it, from a function that gets one symbol's
packet. It is called once for each node of a level, of which there are at most as many as steps are left.
"""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from factgraph.operators.validate import parse_response

#: Bytes of an error answer that are kept.
ERROR_BODY = 2048
#: What the model is asked, and rationales where a decision gives none.
SYSTEM = 'Classify call candidates into accepted, ambiguous, or rejected. Return strict JSON: {"decisions": [...], "notes": [...]}.'
UNMATCHED = "decision target did not map to an evidence-backed candidate"
UNRESOLVED = "accepted decision did not resolve to an evidence-backed target symbol"


class ReviewError(Exception):
    pass


@dataclass(frozen=True)
class RemoteReviewer:
    """POST <url>/chat/completions, temperature 0, JSON answers; retries + 1 attempts without a pause between them."""

    url: str
    model: str
    key: str = ""
    timeout: int = 15
    retries: int = 2

    def __call__(self, packet: dict, depth: int) -> dict:
        attempts, last = (self.retries if self.retries > 0 else 2) + 1, None
        for _ in range(attempts):
            try:
                return self.once(packet, depth)
            except (ReviewError, ValueError, OSError) as e:
                last = e
        raise ReviewError(f"review failed after {attempts} attempt(s): {last}")

    def once(self, packet: dict, depth: int) -> dict:
        body = {"model": self.model, "messages": [{"role": "system", "content": SYSTEM}, {"role": "user", "content": f"Depth={depth}\nPacket={json.dumps(packet)}"}], "temperature": 0, "response_format": {"type": "json_object"}}
        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(self.url.rstrip("/") + "/chat/completions", json.dumps(body).encode(), headers)
        try:
            with urllib.request.urlopen(request, timeout=self.timeout if self.timeout > 0 else 15) as answer:
                found = json.loads(answer.read())
        except urllib.error.HTTPError as e:
            text = e.read(ERROR_BODY).decode("utf-8", "replace").strip()
            raise ReviewError(f"status {e.code}: {text}" if text else f"status {e.code}") from e
        choices = found.get("choices") or []
        if not choices:
            raise ReviewError("answer has no choices")
        return parse_response(choices[0]["message"]["content"])


def match(decisions: list[dict], candidates: list[dict]) -> list[dict]:
    """The steps that decisions make of a symbol's candidates.

    A decision names a candidate by symbol id, else by canonical name; the last candidate of a key counts. What
    matches no candidate, or is accepted without a known symbol, becomes ambiguous.
    """
    known: dict[str, dict] = {}
    for c in candidates:
        for k in (c["call_id"], c["target_symbol_id"], c["target_canonical_name"]):
            if k:
                known[k] = c
    out = []
    for n, d in enumerate(decisions):
        symbol, canonical = d.get("target_symbol_id") or "", d.get("target_canonical_name") or ""
        c = known.get(symbol) or known.get(canonical)
        status, why = d["status"], d.get("rationale") or ""
        if c is None:
            status, why = "ambiguous", why or UNMATCHED
            c = {"call_id": "", "target_symbol_id": "", "target_canonical_name": "", "evidence_source": ""}
        elif status == "accepted" and not c["target_symbol_id"]:
            status, why = "ambiguous", why or UNRESOLVED
        target = c["target_symbol_id"] or symbol
        out.append({**c, "order_index": n, "status": status, "rationale": why, "target_symbol_id": "" if status == "ambiguous" else target, "target_canonical_name": c["target_canonical_name"] or canonical})
    return out


def unavailable(candidates: list[dict], error: Exception) -> dict:
    """What stands in for a reviewer that fails: every candidate is ambiguous, with the error as rationale."""
    note = f"review unavailable: {error}"
    return {"decisions": [{"target_canonical_name": c["target_canonical_name"] or c["call_id"], "status": "ambiguous", "rationale": note} for c in candidates], "notes": [note]}


OUT = ["call_id", "node", "position", "target_symbol_id", "target_canonical_name", "relationship", "evidence_source", "order_index", "status", "rationale", "notes", "error"]
TYPES = "call_id string, node string, position int, target_symbol_id string, target_canonical_name string, relationship string, evidence_source string, order_index long, status string, rationale string, notes array<string>, error string"


def by_node(review: Callable[[dict, int], dict]) -> Callable[[DataFrame], DataFrame]:
    """A reviewer of edges from one of packets ({symbol_id, candidates}); ``notes`` and ``error`` stand in the first row of a node."""

    def run(edges: DataFrame) -> DataFrame:
        def judge(frame: pd.DataFrame) -> pd.DataFrame:
            frame = frame.sort_values(["order_index", "call_id"])
            candidates = frame[["call_id", "target_symbol_id", "target_canonical_name", "relationship", "evidence_source", "order_index"]].fillna("").to_dict("records")
            error = ""
            try:
                answer = review({"symbol_id": str(frame["node"].iloc[0]), "candidates": candidates}, int(frame["depth"].iloc[0]))
            except (ReviewError, ValueError, OSError) as e:
                answer, error = unavailable(candidates, e), str(e)
            rows = match(answer["decisions"], candidates)
            for n, r in enumerate(rows):
                r |= {"node": frame["node"].iloc[0], "position": int(frame["position"].iloc[0]), "notes": answer["notes"] if n == 0 else [], "error": error if n == 0 else ""}
                r.setdefault("relationship", "")
            return pd.DataFrame(rows, columns=OUT)

        plain = edges.select("call_id", "node", "position", F.coalesce("target_symbol_id", F.lit("")).alias("target_symbol_id"), F.coalesce("target_canonical_name", F.lit("")).alias("target_canonical_name"), "relationship", "evidence_source", F.col("order_index").cast("long").alias("order_index"), "depth")
        return plain.groupBy("node").applyInPandas(judge, T.StructType.fromDDL(TYPES))

    return run
