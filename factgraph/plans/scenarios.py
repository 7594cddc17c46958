"""Registered queries over inlined cases: scalar functions, extractors, routes, packets, reviews and renderings.

Their rows are known by hand and stand in the SQL as values. They test what the driver tables, which hold no source
code, can't.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from factgraph.functions import scalars as S
from factgraph.operators import resolve
from factgraph.operators.staging import staged
from factgraph.operators.validate import parse_response
from factgraph.plans import export, fixture, index, review, reviewer
from factgraph.plans import query as point
from factgraph.sources import scan
from factgraph.sources.extract import EXTRACTORS
from factgraph.sources.routes_go import Handler, package_providers, package_routes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def values(columns: str, rows: list[tuple]) -> str:
    """SELECT of rows; whole numbers are BIGINT."""
    text = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else f"{v}::BIGINT" if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS t({columns})"


def query(columns: str, rows: list[tuple]):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = values(columns, rows)
        return f

    return add


#: (function, first argument, second argument, value)
SCALARS = [
    ("collapse_spaces", "  a \t b\n\nc ", "", "a b c"), ("collapse_spaces", "\u2003x\u00a0", "", "x"), ("trim_all", "\u00a0 a b \u0085", "", "a b"), ("trim_all", "", "", ""),
    ("canonical_name", "pkg", "Recv", "pkg.Recv.f"), ("canonical_name", "pkg", "", "pkg.f"),
    ("module_path", "a/b/__init__.py", "", "a.b"), ("module_path", "src/x/index.ts", "", "src.x"), ("module_path", "a.b/c.d.js", "", "a.b.c.d"), ("module_path", "index.js", "", "index"),
    ("receiver_name", "(s *Server)", "", "Server"), ("receiver_name", "*T", "", "T"), ("receiver_name", "T", "", "T"), ("receiver_name", "()", "", ""),
    ("type_name", "*pkg.Type[int]", "", "Type"), ("type_name", " Plain ", "", "Plain"), ("type_name", "map[string]x.Y", "", "map"),
    ("package_token", "a.b.c", "", "c"), ("package_token", "x/y.z", "", "x/y.z"), ("package_token", "one", "", "one"),
    ("method_hint", "a.b", "Do", "b.Do"), ("method_hint", "x/y", " Do ", "x/y.Do"), ("method_hint", " ", "Do", ""), ("method_hint", "a", "", ""),
    ("method_ref", "pkg.Do", "", "pkg|Do"), ("method_ref", "a.b.c", "", None), ("method_ref", "a/b.c", "", None), ("method_ref", ".x", "", None),
    ("unquote", '"a"', "", "a"), ("unquote", "`b`", "", "b"), ("unquote", "c", "", "c"),
    ("quoted_source", 'import x from "a/b";', "", "a/b"), ("quoted_source", "import 'c'", "", "c"), ("quoted_source", "none", "", ""), ("quoted_source", 'a "b" c "d"', "", 'b" c "d'),
    ("comma_list", " a, ,b,,c ", "", "a|b|c"), ("comma_list", "", "", ""),
    ("identifier", "--adds it! ok--", "", "adds_it__ok"), ("synthetic_test_name", "adds it", "7", "__test_adds_it_7"),
    ("participant", "a.b.do it:now/x-y", "", "do_it_now_x_y"), ("diagram_quote", 'say "hi"', "", "\"say 'hi'\""), ("diagram_quote", "plain", "", "plain"),
    ("short_label", "a/b/c", "", "c"), ("short_label", "a/b/", "", "a/b/"), ("short_label", "x", "", "x"),
    ("node_key", "id1", "p.x", "id1"), ("node_key", "", "p.x", "p.x_" + export.rolling_hash("p.x")), ("rolling_hash", "p.x", "", export.rolling_hash("p.x")), ("rolling_hash", "", "", "1505"),
    ("rationale", "  ", "", "no rationale provided"), ("rationale", "because", "", "because"),
    ("test_framework", "a/b_test.go", "", "go_test"), ("test_framework", "test_x.py", "", "pytest"), ("test_framework", "a/x.spec.ts", "", "jest"), ("test_framework", "a/x.ts", "", None),
    ("framework_hint", "docs/OpenAPI.yaml", "", "openapi"), ("framework_hint", "a.proto", "", "protobuf"), ("framework_hint", "kafka/x", "", "kafka"), ("framework_hint", "x", "", None),
    ("language_of", "a.GO", "", None), ("language_of", "a.yml", "", "yaml"), ("language_of", "a.tsx", "", None), ("file_bucket", "a.GO", "", "go"), ("file_bucket", "x.cjs", "", "javascript"), ("file_bucket", "x.toml", "", "config"), ("file_bucket", "x.md", "", None),
    ("route_path", "///a", "", "//a"), ("route_path", "", "", "/"), ("route_path", "a//b", "", "/a/b"), ("slug", " My-App! ", "", "my_app"), ("slug", "--", "", "workspace"),
]


def _scalar(name: str, a: Column, b: Column) -> Column:
    if name == "canonical_name":
        return S.canonical_name(a, b, F.lit("f"))
    if name == "method_ref":
        r = S.method_ref(a)
        return F.when(r["package"].isNotNull(), F.concat_ws("|", r["package"], r["method"]))
    if name == "comma_list":
        return F.array_join(S.comma_list(a), "|")
    f = getattr(S, name)
    return f(a, b) if name in ("method_hint", "synthetic_test_name", "node_key") else f(a)


@query("name, a, b, value", SCALARS)
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = spark.createDataFrame([r[:3] for r in SCALARS], "name string, a string, b string")
    value = F.lit(None).cast("string")
    for name in dict.fromkeys(r[0] for r in SCALARS):
        value = F.when(F.col("name") == name, _scalar(name, F.col("a"), F.col("b"))).otherwise(value)
    return cases.withColumn("value", value)


#: (case, path, source)
SOURCES = [
    ("go_branch", "b.go", "package p\nfunc f(x T) {\n\tif x.ok() { g() } else { h() }\n\tfor _, y := range x { k(y) }\n\tswitch z := x.(type) { case A: m() }\n\tselect { case <-c: n() }\n}\n"),
    ("go_async", "a.go", "package p\nfunc f() func() {\n\tdefer done()\n\tdefer func() { a() }()\n\tgo run()\n\tgo func() { b() }()\n\twg.Wait()\n\treturn func() { c() }\n}\n"),
    ("go_calls", "c.go", 'package p\nimport l "x/lib"\ntype S struct { c *l.Client; m map[string]q.T }\nfunc (s *S) F() { s.G(); s.c.Do(); l.New(); H(); s.m["a"].X(); (func() {})() }\n'),
    ("py", "m/n.py", "from . import a as b\nimport os.path\nfrom .x.y import z\nclass C(D):\n    @p\n    async def f(self):\n        self.g(b.x(1)).h()\n    def test_it(self): pass\ndef outer():\n    def inner(): q()\n    return inner\nC()()\n"),
    ("py_broken", "w.py", "def a(:\n    b()\nclass K:\n    def m(self):\n        self.n(\n"),
    ("js", "s/a.ts", 'import d, {x as y, z} from "./u"\nimport * as ns from "../k"\nconst r = require("q")\nexport class A { m(a) { this.n(y(1)); return `${z(2)}` } }\nexport const f = async (q) => ns.go(a.b.c())\nexport default function g() { h()() }\ntest("adds it", () => { f(1) })\nexport { f as ff }\n'),
]
EXTRACTED = [
    ("go_branch", "symbol", "f", "function"), ("go_branch", "call", "f", "identifier g"), ("go_branch", "call", "f", "identifier h"), ("go_branch", "call", "f", "identifier k"), ("go_branch", "call", "f", "identifier m"), ("go_branch", "call", "f", "identifier n"),
    ("go_branch", "hint", "f", "branch if x.ok()"), ("go_branch", "hint", "f", "branch for loop at line line 4"), ("go_branch", "hint", "f", "branch switch x"),
    ("go_async", "symbol", "f", "function"), ("go_async", "symbol", "f.$inline_handler_0", "function"), ("go_async", "symbol", "f.$inline_handler_1", "function"), ("go_async", "symbol", "f.$closure_return_0", "function"),
    ("go_async", "call", "f", "identifier done"), ("go_async", "call", "f", "identifier run"), ("go_async", "call", "f.$inline_handler_0", "identifier a"), ("go_async", "call", "f.$inline_handler_1", "identifier b"), ("go_async", "call", "f.$closure_return_0", "identifier c"),
    ("go_async", "hint", "f", "defer defer done()"), ("go_async", "hint", "f", "defer defer func() { a() }()"), ("go_async", "hint", "f", "spawn go run()"), ("go_async", "hint", "f", "spawn go func() { b() }()"), ("go_async", "hint", "f", "wait wg.Wait()"), ("go_async", "hint", "f", "return_handler return func() { c() }"),
    ("go_calls", "symbol", "S", "struct"), ("go_calls", "symbol", "S.F", "method"), ("go_calls", "symbol", "S.F.$inline_handler_0", "function"), ("go_calls", "import", "l", "x/lib"), ("go_calls", "field", "S", "c l"), ("go_calls", "field", "S", "m q"),
    ("go_calls", "call", "S.F", "receiver_selector s G"), ("go_calls", "call", "S.F", "receiver_field_selector c Do"), ("go_calls", "call", "S.F", "import_selector l New"), ("go_calls", "call", "S.F", "identifier H"),
    ("py", "symbol", "C", "class"), ("py", "symbol", "C.f", "method"), ("py", "symbol", "C.test_it", "test_function"), ("py", "symbol", "outer", "function"), ("py", "export", "C", "m.n.C"), ("py", "export", "outer", "m.n.outer"),
    ("py", "import", "b", ". a"), ("py", "import", "os", "os.path"), ("py", "import", "z", ".x.y z"), ("py", "call", "C.f", "member self.g(b.x(1)) h"), ("py", "call", "C.f", "self self g"), ("py", "call", "C.f", "member b x"), ("py", "call", "outer", "identifier q"),
    ("py_broken", "symbol", "a", "function"), ("py_broken", "symbol", "K", "class"), ("py_broken", "symbol", "K.m", "method"), ("py_broken", "export", "a", "w.a"), ("py_broken", "export", "K", "w.K"), ("py_broken", "call", "a", "identifier b"),
    ("js", "symbol", "A", "class"), ("js", "symbol", "A.m", "function"), ("js", "symbol", "f", "function"), ("js", "symbol", "g", "function"), ("js", "symbol", "__test_adds_it_7", "test_function"),
    ("js", "import", "d", "./u default"), ("js", "import", "y", "./u x"), ("js", "import", "z", "./u z"), ("js", "import", "ns", "../k"), ("js", "export", "A", "s.a.A"), ("js", "export", "f", "s.a.f"), ("js", "export", "default", "s.a.g"), ("js", "export", "ff", "s.a.f"),
    ("js", "call", "A.m", "self this n"), ("js", "call", "A.m", "identifier y"), ("js", "call", "A.m", "identifier z"), ("js", "call", "f", "member ns go"), ("js", "call", "f", "member a.b c"), ("js", "call", "g", "dynamic"), ("js", "call", "g", "identifier h"), ("js", "call", "__test_adds_it_7", "identifier f"),
]


def facts_of(spark: SparkSession, cases: list[tuple]) -> DataFrame:
    """(case, fact, owner, detail) of what the extractors find in each case's file."""
    from collections.abc import Iterator

    table = spark.createDataFrame(cases, "case string, path string, source string").withColumn("language", S.language_of(F.col("path")))
    table = table.withColumn("language", F.coalesce("language", S.file_bucket(F.col("path"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for case, path, source, language in zip(*(c.to_pylist() for c in b.columns), strict=True):
                r = EXTRACTORS[language](path, source.encode())
                names = [s["canonical_name"].removeprefix(r["package"] + ".") for s in r["symbols"]]
                out += [(case, "symbol", n, s["kind"]) for n, s in zip(names, r["symbols"], strict=True)]
                out += [(case, "call", names[c["symbol"]], " ".join(x for x in (c["form"], c["operand"], c["name"]) if x)) for c in r["calls"]]
                out += [(case, "hint", names[h["symbol"]], f"{h['kind']} {h['evidence']}") for h in r["hints"]]
                out += [(case, "import", i["alias"], f"{i['source']} {i['imported_name']}".strip()) for i in r["imports"]]
                out += [(case, "export", e["name"], e["canonical_name"]) for e in r["exports"]]
                out += [(case, "field", f["struct"], f"{f['field']} {f['token']}") for f in r["fields"]]
            c = list(zip(*out, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in c], names=["case", "fact", "owner", "detail"])

    return table.mapInArrow(run, "case string, fact string, owner string, detail string")


@query('"case", fact, owner, detail', EXTRACTED)
def extractor_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts_of(spark, SOURCES)


GIN = 'import "github.com/gin-gonic/gin"\n'
#: (case, files of one package)
PACKAGES = {
    "accessor": {
        "s.go": f"package web\n{GIN}type app struct {{ e *gin.Engine }}\nfunc build() *app {{ e := gin.Default(); return &app{{e: e}} }}\nfunc (a *app) Root() *gin.Engine {{ return a.e }}\n",
        "r.go": f"package web\n{GIN}type pages struct{{}}\nfunc (pages) Show(*gin.Context) {{}}\nfunc (a *app) wire() {{\n r := a.Root()\n one := r\n two := one\n g := one.Group(\"/a\").Group(\"b\")\n p := pages{{}}\n g.GET(\"/show\", p.Show)\n r.POST(\"\", func(c *gin.Context) {{}})\n r.GET(\"/wrapped\", wrap(p.Show))\n two.GET(\"/lost\", p.Show)\n a.other().GET(\"/x\", p.Show)\n r.PUT(\"/few\")\n r.Any(name, p.Show)\n}}\n",
    },
    "providers": {"r.go": f"package web\n{GIN}import (\"example.com/cams\"; \"example.com/wrap\")\nfunc first() T {{ return cams.NewCams() }}\nfunc second() T {{ return first() }}\nfunc wire() {{\n e := gin.New()\n a := cams.NewCams()\n b := a\n c := b\n d, f, g := first(), second(), wrap.Cameras()\n e.GET(\"/a\", a.Show)\n e.GET(\"/b\", b.Show)\n e.GET(\"/c\", c.Show)\n e.GET(\"/d\", d.Show())\n e.GET(\"/f\", f.Show())\n e.GET(\"/g\", g.Show)\n}}\n"},
    "helpers": {"m.go": f"package web\n{GIN}import h \"example.com/handler\"\nfunc root(r *gin.Engine) {{ v := r.Group(\"/s/v1\"); inner(v) }}\nfunc inner(g gin.IRoutes) {{ x := h.NewHandler(); g.POST(\"/p\", x.Predict); inner(g) }}\nfunc main() {{ e := gin.New(); root(e); root(e) }}\n"},
    "mux": {"s.go": 'package web\nimport "net/http"\ntype ServeMux struct{}\ntype mine struct { mux *ServeMux }\ntype server struct { mux *http.ServeMux }\nfunc made() http.HandlerFunc { return nil }\nfunc (s *server) wire() {\n http.HandleFunc("/top", list)\n s.mux.Handle("/field", made())\n m := http.NewServeMux()\n n := m\n n.HandleFunc("/alias", pkg.list)\n l := mine{}\n l.mux.HandleFunc("/shadow", list)\n}\n'},
    "gateway": {"g.go": 'package web\nimport gw "github.com/grpc-ecosystem/grpc-gateway/v2/runtime"\nfunc wire(ctx C) error {\n m := gw.NewServeMux()\n RegisterOneHandler(ctx, m)\n go pb.RegisterTwoHandlerServer(ctx, m)\n RegisterThreeHandler(ctx, other)\n RegisterFourHandler(ctx)\n return RegisterFiveHandlerFromEndpoint(ctx, m, "x")\n}\n'},
}
ROUTES = [
    ("accessor", "GET /a/b/show", "web.pages.Show", ""), ("accessor", "POST /", "web.app.wire.$inline_handler_0", ""), ("accessor", "GET /wrapped", "", ""), ("accessor", "", "", "boundary_unresolved_handler_target"),
    ("accessor", "", "", "boundary_unproven_receiver"), ("accessor", "", "", "boundary_unsupported_accessor_pattern"), ("accessor", "", "", "boundary_insufficient_args"), ("accessor", "", "", "boundary_nonliteral_path"),
    ("providers", "GET /a", "cams.Show", ""), ("providers", "GET /b", "cams.Show", ""), ("providers", "GET /c", "", ""), ("providers", "GET /d", "cams.Show", ""), ("providers", "GET /f", "", ""), ("providers", "GET /g", "inner.Show", ""), ("providers", "", "", "boundary_unresolved_handler_target"), ("providers", "", "", "boundary_unresolved_handler_target"),
    ("helpers", "POST /s/v1/p", "h.Predict", ""), ("helpers", "POST /s/v1/p", "h.Predict", ""),
    ("mux", "ANY /top", "list", ""), ("mux", "ANY /field", "made", ""), ("mux", "ANY /alias", "pkg.list", ""), ("mux", "", "", "boundary_unproven_receiver"),
    ("gateway", "PROXY RegisterOneHandler", "RegisterOneHandler", ""), ("gateway", "PROXY RegisterTwoHandlerServer", "RegisterTwoHandlerServer", ""), ("gateway", "PROXY RegisterFiveHandlerFromEndpoint", "RegisterFiveHandlerFromEndpoint", ""), ("gateway", "", "", "boundary_unproven_receiver"), ("gateway", "", "", "boundary_insufficient_args"),
]


@query('"case", route, target, category', ROUTES)
def route_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each package interpreted alone, given that wrap.Cameras returns a handler of package inner."""
    import pandas as pd

    table = spark.createDataFrame([(case, p, t) for case, files in PACKAGES.items() for p, t in files.items()], "case string, path string, source string")

    def run(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        found = package_routes([(p, t.encode()) for p, t in zip(frame["path"], frame["source"], strict=True)], {("wrap", "Cameras"): Handler("inner")})
        return pd.DataFrame([(keys[0], r["canonical_name"], r["handler_target"], r["category"]) for r in found], columns=["case", "route", "target", "category"])

    return table.groupBy("case").applyInPandas(run, "case string, route string, target string, category string")


@query("token, name, to_token, to_type", [("wrap", "Cameras", "in", ""), ("wrap", "Own", "wrap", "T")])
def provider_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the functions of a package return: constructors of others, own types, and not what other providers give."""
    source = 'package wrap\nimport in "example.com/inner"\nfunc Cameras() X { return in.NewCams() }\nfunc Own() *T { return &T{} }\nfunc (t *T) M() *T { return &T{} }\nfunc Deep() *T { return Own() }\n'
    table = spark.createDataFrame([("w.go", source)], "path string, source string")

    def run(batches):
        for b in batches:
            for path, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                c = list(zip(*package_providers([(path, text.encode())]), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.string()) for x in c], names=["token", "name", "to_token", "to_type"])

    return table.mapInArrow(run, "token string, name string, to_token string, to_type string")


TREE = {
    "r/go.mod": "module example.com/r\n",
    "r/web/web.go": f"package web\n{GIN}import (\"example.com/r/cam\"; \"example.com/r/two\")\nfunc wire() {{ e := gin.New(); a := cam.Get(); b := two.Get(); e.GET(\"/a\", a.Show); e.GET(\"/b\", b.Show) }}\n",
    "r/cam/cam.go": 'package cam\nimport "example.com/r/inner"\nfunc Get() X { return inner.NewX() }\n',
    "r/x/two/two.go": 'package two\nimport "example.com/r/inner"\nfunc Get() X { return inner.NewX() }\n',
    "r/y/two/two.go": 'package two\nimport "example.com/r/other"\nfunc Get() X { return other.NewX() }\n',
}


@query("path, handler_target", [("/a", "inner.Show"), ("/b", "")])
def imported_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Handlers from other packages of the workspace: where packages of a name disagree, none is taken."""
    files = staged(spark.createDataFrame([(p, t.encode()) for p, t in TREE.items()], "relative_path string, content binary"), "tree")
    return index.index_workspace(files, "2024-01-01T00:00:00")["boundaries"].select("path", "handler_target")


def _facts(spark: SparkSession) -> index.Index:
    return index.index_workspace(fixture.files(spark), "2024-01-01T00:00:00", "/w", 1)


@query("canonical_name, file_path, start_line", [("service.TestHandle", "internal/service/service_test.go", 5)])
def fact_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark)["tests"].select("canonical_name", "file_path", F.col("start_line").cast("long").alias("start_line"))


RUN = ["repository_count", "file_count", "symbol_count", "call_candidate_count", "skipped_ignored_files", "unresolved_imports", "ambiguous_relations", "unsupported_constructs", "service_attribution_ambiguities", "deferred_boundary_stitching"]


@query(", ".join(RUN), [(2, 12, 21, 17, 1, 0, 1, 0, 0, 0)])
def fact_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark)["index_runs"].select(*RUN)


@query("id, name, languages, build_files, frameworks", [("repo_svc", "svc", "go", "svc/go.mod", "protobuf"), ("repo_web", "web", "javascript,json,python", "web/package.json", "")])
def fact_repositories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _facts(spark)["repositories"].select("id", "name", *[F.array_join(c, ",").alias(c) for c in ("languages", "build_files", "frameworks")])


@query("entry", [("web/node_modules",), ("svc/Dockerfile",), ("web/pkg",)])
def scan_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a walk skips: a folder once, by default name or by pattern, and single files."""
    listing = spark.createDataFrame([(p,) for p in [*fixture.WORKSPACE, "web/pkg/more.py", "web/node_modules/y/z.js"]], "relative_path string")
    return scan.skipped(listing, scan.IgnorePolicy(["Docker*", "./svc/Dockerfile/", "web/pk"])).select("entry")


@query("root, language, files", [("svc", "go", "svc/internal/helper/helper.go,svc/internal/service/service.go,svc/internal/service/service_test.go,svc/main.go"), ("web", "javascript", "web/src/index.js,web/src/lib.js"), ("web", "python", "web/app.py,web/pkg/util.py")])
def scan_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = fixture.files(spark)
    placed = scan.assign_repository(files, scan.repository_roots(files))
    return scan.extraction_plans(placed).select("root", "language", F.array_join("files", ",").alias("files"))


PACKET = ("service.Server.Handle", "internal/service/service.go", "/w/svc/internal/service/service.go", "example.com/one/internal/helper,example.com/one/internal/helper,sync,sync", "service.Server.done,sync.Wait", "", "func (s *Server) Handle(in string) func() {", 8)


@query("symbol, file, absolute_path, imports, outgoing, tests, first_line, source_lines", [PACKET])
def fact_packet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The neighbourhood packet of one symbol, found by its name."""
    tables = _facts(spark).tables
    root = point.find_symbol(tables["symbols"], "service.Server.Handle")
    body = fixture.files(spark).select(F.lit("repo_svc").alias("repository_id"), F.regexp_replace("relative_path", "^svc/", "").alias("path"), "content")
    packet = point.context_packet(tables, root, body, 2)
    names = lambda c, f: F.array_join(F.transform(c, lambda x: x[f]), ",").alias(c)
    return packet.select(F.col("symbol.canonical_name").alias("symbol"), F.col("file.relative_path").alias("file"), F.col("file.absolute_path").alias("absolute_path"), names("imports", "source"), names("outgoing", "target_canonical_name"), names("tests", "name"), F.substring_index("function_source", "\n", 1).alias("first_line"), F.size(F.split("function_source", "\n")).cast("long").alias("source_lines"))


#: A review below p.root: accepted, ambiguous, rejected, a cycle, and a symbol that is not known.
SYMBOLS = [("root", "p.root"), ("child", "p.child"), ("grand", "q.grand"), ("late", "p.late")]
CALLS = [("c1", "root", "child", "p.child", "calls", 1), ("c2", "root", "", "p.gone", "calls", 2), ("c3", "root", "late", "p.late", "Test", 3), ("c4", "child", "root", "p.root", "calls", 1), ("c5", "child", "grand", "q.grand", "calls", 2), ("c6", "grand", "lost", "q.lost", "calls", 1), ("c7", "late", "root", "p.root", "calls", 1)]
STEPS = [
    (1, 0, "p.root", "p.child", "child", "accepted", "target symbol is present in indexed facts", ""), (2, 0, "p.root", "p.gone", "", "ambiguous", "candidate is unresolved and needs verification", ""),
    (3, 0, "p.root", "p.late", "late", "rejected", "test edge excluded from runtime flow", ""), (4, 1, "p.child", "p.root", "root", "accepted", "target symbol is present in indexed facts", ""),
    (5, 1, "p.child", "q.grand", "grand", "accepted", "target symbol is present in indexed facts", ""), (6, 2, "q.grand", "q.lost", "", "ambiguous", "target symbol is present in indexed facts", "failed to load symbol lost"),
]


def _graph(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    symbols = spark.createDataFrame(SYMBOLS, "id string, canonical_name string")
    calls = spark.createDataFrame(CALLS, "id string, source_symbol_id string, target_symbol_id string, target_canonical_name string, relationship string, order_index long").withColumn("evidence_source", F.lit("e"))
    return calls, symbols, symbols.where("id = 'root'")


def _shown(steps: DataFrame) -> DataFrame:
    return steps.select(F.col("step").cast("long").alias("step"), F.col("depth").cast("long").alias("depth"), F.col("from_canonical_name").alias("source"), F.col("to_canonical_name").alias("target"), "to_symbol_id", "status", "rationale", F.coalesce(F.array_join("notes", ","), F.lit("")).alias("notes"))


@query("step, depth, source, target, to_symbol_id, status, rationale, notes", STEPS)
def review_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(review.traverse(*_graph(spark)))


@query("step, depth, source, target, to_symbol_id, status, rationale, notes", STEPS[:4])
def review_step_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(review.traverse(*_graph(spark), max_steps=4))


def _answers(packet: dict, depth: int) -> dict:
    """A reviewer that rejects the first candidate, accepts others by name, names one that does not exist, and fails for child."""
    if packet["symbol_id"] != "root":
        raise reviewer.ReviewError("no answer")
    first, *rest = packet["candidates"]
    named = [{"target_symbol_id": first["target_symbol_id"], "status": "rejected", "rationale": "no"}, *({"target_canonical_name": c["target_canonical_name"], "status": "accepted"} for c in rest), {"target_canonical_name": "p.none", "status": "accepted"}]
    return parse_response(json.dumps({"decisions": named, "notes": ["looked"]}))


JUDGED = [
    (1, 0, "p.root", "p.child", "child", "rejected", "no", "looked"), (2, 0, "p.root", "p.gone", "", "ambiguous", reviewer.UNRESOLVED, ""), (3, 0, "p.root", "p.late", "late", "accepted", "", ""), (4, 0, "p.root", "p.none", "", "ambiguous", reviewer.UNMATCHED, ""),
    (5, 1, "p.late", "p.root", "", "ambiguous", "review unavailable: no answer", "review unavailable: no answer"),
]


@query("step, depth, source, target, to_symbol_id, status, rationale, notes", JUDGED)
def review_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions matched to candidates, and the fallback where the reviewer fails."""
    return _shown(review.traverse(*_graph(spark), reviewer.by_node(_answers)))


RESPONSES = [
    ('{"decisions": [{"status": "accepted", "target_symbol_id": "a"}]}', True), ('{"decisions": [{"status": "rejected", "target_canonical_name": "a"}], "notes": ["n"]}', True), ('{"decisions": []}', False), ("{}", False), ('{"decisions": [{"status": "maybe", "target_symbol_id": "a"}]}', False),
    ('{"decisions": [{"status": "accepted", "target_symbol_id": " "}]}', False), ('{"decisions": [{"status": "accepted", "target_symbol_id": "a", "x": 1}]}', False), ('{"y": 1, "decisions": [{"status": "accepted", "target_symbol_id": "a"}]}', False), ('{"decisions": [{"status": "accepted", "target_symbol_id": "a"}]} {}', False), ("[]", False), ("no", False),
]


@query("body, valid", RESPONSES)
def response_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict decoding of reviewers' answers."""

    def run(batches):
        for b in batches:
            bodies, good = b.column(0).to_pylist(), []
            for body in bodies:
                try:
                    good.append(bool(parse_response(body)))
                except ValueError:
                    good.append(False)
            yield pa.RecordBatch.from_arrays([pa.array(bodies, pa.string()), pa.array(good)], names=["body", "valid"])

    return spark.createDataFrame([(x,) for x, _ in RESPONSES], "body string").mapInArrow(run, "body string, valid boolean")


FLOW = [{"from_symbol_id": "root", "from_canonical_name": "p.root", "to_symbol_id": "child", "to_canonical_name": "p.child", "status": "accepted", "rationale": "why: this"}, {"from_symbol_id": "child", "from_canonical_name": "p.child", "to_symbol_id": "x" * 70, "to_canonical_name": "q/r.child", "status": "accepted", "rationale": " "}, {"from_symbol_id": "root", "from_canonical_name": "p.root", "to_symbol_id": "", "to_canonical_name": "p.gone", "status": "ambiguous", "rationale": "?"}]
LONG = "q/r.child_" + export.rolling_hash("q/r.child")
RENDERED = [
    ("markdown", "# Flow Review\n\n- root: `p.root`\n- review_id: `r1`\n- accepted: `2`\n- ambiguous: `1`\n- rejected: `0`\n\n## Accepted Steps\n\n- `p.root` -> `p.child`: why: this\n- `p.child` -> `q/r.child`: no rationale provided\n\n## Uncertainty Notes\n\n- n\n\n"),
    ("mermaid", f'sequenceDiagram\n    participant child_{LONG[-6:]}\n    participant child_child\n    participant root\n    root->>child_child: "why: this"\n    child_child->>child_{LONG[-6:]}: calls\n'),
    ("graph", json.dumps({"nodes": [{"id": "child", "label": "p.child"}, {"id": LONG, "label": "r.child"}, {"id": "root", "label": "p.root"}], "edges": [{"source": "root", "target": "child", "label": "why: this"}, {"source": "child", "target": LONG, "label": "calls"}]})),
]


@query("kind, body", RENDERED)
def renderings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reviewed flow, bounded by its step cap, rendered by the driver."""
    made = [("markdown", export.markdown("p.root", FLOW, ["n"], "r1")), ("mermaid", export.mermaid("p.root", FLOW)), ("graph", json.dumps(export.graph_json("root", "p.root", FLOW)))]
    return spark.createDataFrame(made, "kind string, body string")


@query("id, target, path", [(1, "a", "f1"), (2, "b", "given"), (3, "zz", ""), (4, "", "")])
def back_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame([(1, "a", ""), (2, "b", "given"), (3, "zz", None), (4, "", "")], "id long, target string, path string")
    return resolve.back_fill(rows, "path", spark.createDataFrame([("a", "f1"), ("b", "f2")], "id string, file string"), "target", "id", "file")
