import http.server
import io
import json
import threading
from pathlib import Path

import pytest

from factgraph import cli, progress
from factgraph.operators.validate import parse_response
from factgraph.plans import export, query, review, reviewer
from factgraph.progress import Reporter
from factgraph.settings import Settings
from factgraph.sources import store
from factgraph.sources.artifacts import ArtifactStore

TREE = {
    "svc/go.mod": "module example.com/one\n",
    "svc/internal/helper/helper.go": "package helper\n\nfunc Transform(x string) string { return x }\n",
    "svc/internal/service/service.go": 'package service\n\nimport "example.com/one/internal/helper"\n\nfunc Handle(in string) string {\n\treturn stepOne(helper.Transform(in))\n}\n\nfunc stepOne(in string) string { return in }\n',
    "svc/internal/service/service_test.go": 'package service\n\nimport "testing"\n\nfunc TestHandle(t *testing.T) { Handle("x") }\n',
    "svc/main.go": 'package main\n\nimport "net/http"\n\nfunc main() { http.HandleFunc("/ping", ping) }\n\nfunc ping(w http.ResponseWriter, r *http.Request) {}\n',
    "web/package.json": '{"scripts": {"start": "node src/index.js"}}',
    "web/src/index.js": 'import { go } from "./lib";\nexport function main() { go(); missing.call(); }\n',
    "web/src/lib.js": "export function go() {}\n",
    "web/app.py": "import pkg.util\n\ndef run():\n    pkg.util.work()\n",
    "web/pkg/util.py": "def work():\n    pass\n",
    "web/node_modules/x/skip.js": "export function skipped() {}\n",
    "web/ignored/y.js": "export function ignored() {}\n",
}


@pytest.fixture(scope="module")
def snapshot(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("ws")
    for path, text in TREE.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    where = str(tmp_path_factory.mktemp("store"))
    args = cli.parser().parse_args(["index", "--workspace", str(root), "--ignore", "ignored", "--store", where])
    return where, cli.run(args, spark), str(root)


def test_snapshot_tables(spark, snapshot):
    where, made, _ = snapshot
    load = lambda t: store.load(spark, where, t, made["workspace_id"], made["snapshot_id"])
    names = {r["canonical_name"]: r for r in load("symbols").collect()}
    assert {"service.Handle", "service.stepOne", "helper.Transform", "service.TestHandle", "src.main", "src.lib.go", "app.run", "pkg.util.work"} <= set(names) and not any("skip" in n or "ignored" in n for n in names)
    by_id = {r["id"]: n for n, r in names.items()}
    edges = {(by_id[r["source_symbol_id"]], by_id.get(r["target_symbol_id"], r["target_canonical_name"])) for r in load("call_candidates").collect()}
    assert {("service.Handle", "service.stepOne"), ("service.Handle", "helper.Transform"), ("service.TestHandle", "service.Handle"), ("src.main", "src.lib.go"), ("app.run", "pkg.util.work")} <= edges
    assert [(r["framework"], r["method"], r["path"], r["handler_target"]) for r in load("boundaries").collect()] == [("net/http", "ANY", "/ping", "ping")]
    assert {(r["name"], r["role"]) for r in load("repositories").collect()} == {("svc", "service"), ("web", "service")}
    assert {r["name"] for r in load("services").collect()} == {"svc", "web"}
    assert [r["canonical_name"] for r in load("tests").collect()] == ["service.TestHandle"]
    assert "ambiguous_relation" in {r["category"] for r in load("diagnostics").collect()}
    assert made["counts"]["repository_count"] == 2


def test_inspect_review_and_exports(spark, snapshot, tmp_path):
    where, made, _ = snapshot
    common = ["--workspace-id", made["workspace_id"], "--snapshot-id", made["snapshot_id"], "--symbol", "service.Handle", "--store", where]
    packet = cli.run(cli.parser().parse_args(["inspect-function", *common]), spark)
    assert packet["function_source"].startswith("func Handle(") and packet["function_source"].endswith("}") and packet["surrounding_context"].startswith("package service")
    near = cli.run(cli.parser().parse_args(["inspect-function", *common, "--context-window", "1"]), spark)
    assert near["surrounding_context"].split("\n")[1:-1] == near["function_source"].split("\n")
    assert [c["target_canonical_name"] for c in packet["outgoing"]] == ["service.stepOne", "example.com/one/internal/helper.Transform"] and len(packet["incoming"]) == 1 and not packet["tests"]
    made_flow = cli.run(cli.parser().parse_args(["review-flow", *common, "--out", str(tmp_path)]), spark)
    flow = made_flow["flow"]
    assert flow["uncertainty_notes"] == [] and Path(made_flow["uncertainty_md"]).read_text() == ""
    assert store.load_flow(spark, where, flow["workspace_id"], flow["snapshot_id"], flow["id"]) == flow
    store.save_flow(spark, where, flow | {"root_canonical_name": "again"})
    assert store.load_flow(spark, where, flow["workspace_id"], flow["snapshot_id"], flow["id"])["root_canonical_name"] == "again"
    assert store.load_flow(spark, where, flow["workspace_id"], flow["snapshot_id"], "none") is None
    assert [s["status"] for s in flow["steps"]] == ["accepted", "accepted"] and json.loads((tmp_path / "flow.json").read_text()) == flow
    for command in ("export-md", "export-mermaid", "export-graphjson"):
        assert "stepOne" in cli.run(cli.parser().parse_args([command, "--review", str(tmp_path / "flow.json")]), None)


def test_traversal_classifies_cycles_and_caps(spark):
    symbols = spark.createDataFrame([(s, f"p.{s}") for s in ("root", "child", "grand", "rejected")], "id string, canonical_name string")
    calls = spark.createDataFrame(
        [("c1", "root", "child", "p.child", "calls", 1), ("c2", "root", "", "p.gone", "calls", 2), ("c3", "root", "rejected", "p.rejected", "test", 3), ("c4", "child", "root", "p.root", "calls", 1), ("c5", "child", "grand", "p.grand", "calls", 2)],
        "id string, source_symbol_id string, target_symbol_id string, target_canonical_name string, relationship string, order_index int",
    ).selectExpr("*", "'e' evidence_source")
    root = symbols.where("id = 'root'")
    steps = sorted((r["step"], r["depth"], r["to_canonical_name"], r["status"]) for r in review.traverse(calls, symbols, root).collect())
    assert steps == [(1, 0, "p.child", "accepted"), (2, 0, "p.gone", "ambiguous"), (3, 0, "p.rejected", "rejected"), (4, 1, "p.root", "accepted"), (5, 1, "p.grand", "accepted")]
    assert review.traverse(calls, symbols, root, max_steps=2).count() == 2
    assert review.traverse(calls, symbols, root, max_depth=0).count() == 3

    def silent(packet, depth):
        raise reviewer.ReviewError("no answer")

    lost = sorted(review.traverse(calls, symbols, root, reviewer.by_node(silent)).collect(), key=lambda r: r["step"])
    assert [(r["status"], r["to_symbol_id"], r["to_canonical_name"]) for r in lost] == [("ambiguous", "", "p.child"), ("ambiguous", "", "p.gone"), ("ambiguous", "", "p.rejected")]
    assert lost[0]["error"] == "no answer" and lost[0]["notes"] == ["review unavailable: no answer"] and not lost[1]["error"]
    assert review.traverse(calls, symbols, symbols.where("id = 'grand'")).count() == 0
    assert query.find_symbol(symbols, "p.child").first()["id"] == "child"


def test_decisions_meet_candidates():
    candidates = [{"call_id": "c1", "target_symbol_id": "a", "target_canonical_name": "p.a", "evidence_source": "x"}, {"call_id": "c2", "target_symbol_id": "", "target_canonical_name": "p.b", "evidence_source": ""}, {"call_id": "c3", "target_symbol_id": "d", "target_canonical_name": "p.a", "evidence_source": ""}]
    decisions = [
        {"target_symbol_id": "a", "status": "accepted", "rationale": "r"}, {"target_canonical_name": "p.b", "status": "accepted"}, {"target_canonical_name": "p.a", "status": "rejected"},
        {"target_symbol_id": "zz", "target_canonical_name": "p.zz", "status": "accepted"}, {"target_symbol_id": "zz", "target_canonical_name": "c1", "status": "accepted", "rationale": "by id"},
    ]
    got = [(r["call_id"], r["status"], r["target_symbol_id"], r["target_canonical_name"], r["rationale"]) for r in reviewer.match(decisions, candidates)]
    assert got == [("c1", "accepted", "a", "p.a", "r"), ("c2", "ambiguous", "", "p.b", reviewer.UNRESOLVED), ("c3", "rejected", "d", "p.a", ""), ("", "ambiguous", "", "p.zz", reviewer.UNMATCHED), ("c1", "accepted", "a", "p.a", "by id")]


class Answers(http.server.BaseHTTPRequestHandler):
    replies, seen = [], []

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.seen.append((self.path, self.headers.get("Authorization"), body))
        code, text = self.replies.pop(0)
        self.send_response(code)
        self.end_headers()
        self.wfile.write(text.encode())

    def log_message(self, *args):
        pass


def test_remote_reviewer():
    server = http.server.HTTPServer(("127.0.0.1", 0), Answers)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    good = json.dumps({"choices": [{"message": {"content": '{"decisions": [{"status": "accepted", "target_symbol_id": "a"}], "notes": ["n"]}'}}]})
    client = reviewer.RemoteReviewer(f"http://127.0.0.1:{server.server_port}/v1/", "m", "k", timeout=5, retries=1)
    Answers.replies[:] = [(500, "x" * 5000), (200, good)]
    assert client({"symbol_id": "s", "candidates": []}, 2)["notes"] == ["n"]
    path, key, body = Answers.seen[-1]
    assert path == "/v1/chat/completions" and key == "Bearer k" and body["temperature"] == 0 and body["response_format"] == {"type": "json_object"} and body["messages"][1]["content"].startswith("Depth=2\nPacket=")
    Answers.replies[:] = [(500, "x" * 5000), (503, "")]
    with pytest.raises(reviewer.ReviewError, match=r"after 2 attempt\(s\): status 503$"):
        client({"symbol_id": "s", "candidates": []}, 0)
    with pytest.raises(reviewer.ReviewError) as e:
        Answers.replies[:] = [(400, "y" * 5000)]
        client.once({}, 0)
    assert len(str(e.value)) == len("status 400: ") + 2048
    Answers.replies[:] = [(200, '{"choices": []}')] * 2
    with pytest.raises(reviewer.ReviewError, match="no choices"):
        client({}, 0)
    server.shutdown()


def test_settings_and_progress():
    assert Settings.read({}) == Settings() and Settings.read({"FACTGRAPH_REVIEWER_TIMEOUT": "0", "FACTGRAPH_REVIEWER_RETRIES": "x"}) == Settings()
    assert Settings.read({"FACTGRAPH_STORE": "s", "FACTGRAPH_REVIEWER_TIMEOUT": "7", "FACTGRAPH_REVIEWER_RETRIES": "0"}) == Settings(store="s", reviewer_timeout=7, reviewer_retries=0)
    out, now = io.StringIO(), [0.0]
    r = Reporter("auto", out, lambda: now[0])
    r.start("scan", 400, "go")
    r.advance(50)
    r.advance(60)
    now[0] = 1
    r.advance(1, "more")
    r.finish("done")
    assert out.getvalue().splitlines() == ["stage=scan current=0 total=400 status=go", "stage=scan current=110 total=400 status=go", "stage=scan current=111 total=400 status=more", "stage=scan current=111 total=400 status=done"]
    out = io.StringIO()
    r = Reporter("tty", out)
    r.start("x", 40)
    r.advance(10)
    assert out.getvalue().endswith("\r[#####...............] x 10/40 ") and progress.bar(5, 0) == "[....]"


def test_scan_counts_and_artifacts(spark, snapshot, tmp_path):
    _, _, root = snapshot
    found = cli.run(cli.parser().parse_args(["scan", "--workspace", root, "--ignore", "ignored, ./ignored/", "--store", str(tmp_path), "--progress-mode", "quiet"]), spark)
    assert found["inventory"]["issue_counts"]["skipped_ignored_files"] == 2  # a folder counts once
    assert [r["root_path"] for r in found["inventory"]["repositories"]] == ["svc", "web"] and [s["name"] for s in found["service_manifests"]] == ["svc", "web"]
    assert [(p["repository_id"], p["language"], len(p["files"])) for p in found["inventory"]["plans"]] == [("repo_svc", "go", 4), ("repo_web", "javascript", 2), ("repo_web", "python", 2)]
    assert [r["type"] for r in found["artifact_refs"]] == ["workspace_manifest", "repository_manifests", "service_manifests", "scan_warnings"]
    assert json.loads(Path(found["artifact_refs"][0]["path"]).read_text()) == found["workspace_manifest"]
    with pytest.raises(ValueError):
        ArtifactStore(str(tmp_path)).save_text("w", "s", "x", "other", "")


def test_snapshot_files(spark, snapshot):
    where, made, _ = snapshot
    assert made["counts"]["skipped_ignored_files"] == 2 and made["counts"]["symbol_count"] > 5
    listed = json.loads(Path(made["jsonl"]["index_path"]).read_text())
    assert listed["symbol_count"] == made["counts"]["symbol_count"]
    names = {r["canonical_name"] for r in spark.read.json(made["jsonl"]["symbols_path"]).collect()}
    assert "service.Handle" in names
    store.delete(spark, where, ["symbols"], "none", "none")
    rows = store.load(spark, where, "symbols", made["workspace_id"], made["snapshot_id"])
    store.save({"symbols": rows}, where, made["workspace_id"], "other")
    assert store.load(spark, where, "symbols", made["workspace_id"], "other").count() == rows.count()
    store.delete(spark, where, ["symbols"], made["workspace_id"], "other")
    assert store.load(spark, where, "symbols", made["workspace_id"], "other").count() == 0 < rows.count()


def test_renderings():
    steps = [{"from_symbol_id": "a1", "from_canonical_name": "p.x", "to_symbol_id": "", "to_canonical_name": "q.x", "status": "accepted", "rationale": " "}]
    text = export.mermaid("p.x", steps)
    assert export.markdown("p.x", steps, ["n"], "r1").split("\n") == ["# Flow Review", "", "- root: `p.x`", "- review_id: `r1`", "- accepted: `1`", "- ambiguous: `0`", "- rejected: `0`", "", "## Accepted Steps", "", "- `p.x` -> `q.x`: no rationale provided", "", "## Uncertainty Notes", "", "- n", "", ""]
    assert "- none" in export.markdown("p.x", [], [])
    assert "x_a1" in text and text.count("participant") == 2 and ": calls" in text
    graph = export.graph_json("a1", "p.x", steps)
    assert len(graph["nodes"]) == 2 and graph["edges"][0]["label"] == "calls" and [n["id"] for n in graph["nodes"]] == sorted(n["id"] for n in graph["nodes"])


@pytest.mark.parametrize("text", ['{"decisions": []}', '{"decisions": [{"status": "maybe", "target_symbol_id": "a"}]}', '{"decisions": [{"status": "accepted"}]}', '{"x": 1, "decisions": []}', '{"decisions": [{"status": "accepted", "target_symbol_id": "a", "y": 1}]}', '{"decisions": []} x'])
def test_bad_responses(text):
    with pytest.raises(ValueError):
        parse_response(text)


def test_good_response():
    assert parse_response('{"decisions": [{"status": "accepted", "target_symbol_id": "a", "rationale": "r"}]}')["notes"] == []
