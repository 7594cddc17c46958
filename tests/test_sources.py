from factgraph.operators.staging import staged
from factgraph.plans import index
from factgraph.sources.facts_go import go_facts
from factgraph.sources.facts_js import js_facts
from factgraph.sources.facts_python import import_candidates, python_facts
from factgraph.sources.go_syntax import parse
from factgraph.sources.extract import EXTRACTORS
from factgraph.sources.routes_go import DETECTORS, Handler, package_providers, package_routes

GO = b"""package service
import h "example.com/x/helper"
type S struct { a *h.Client; b, c map[string]repo.T }
func (s *S) Handle(x string) func() {
  defer s.done()
  go func() { s.a.Run(h.Do(x)) }()
  if x == "" { for i := range x { wg.Wait() } }
  switch v := x.(type) { case string: stepOne(v) }
  return func() { stepTwo() }
}
"""


def test_go_symbols_calls_and_hints():
    r = go_facts("a/s.go", GO)
    assert [s["canonical_name"] for s in r["symbols"]] == ["service.S", "service.S.Handle", "service.S.Handle.$inline_handler_0", "service.S.Handle.$closure_return_0"]
    assert [(c["symbol"], c["order_index"], c["form"], c["name"]) for c in r["calls"]] == [(1, 0, "receiver_selector", "done"), (2, 0, "receiver_field_selector", "Run"), (2, 1, "import_selector", "Do"), (1, 3, "identifier", "stepOne"), (3, 0, "identifier", "stepTwo")]
    assert [(h["kind"], h["order_index"], h["evidence"]) for h in r["hints"]][3] == ("branch", 3, "for loop at line line 7")
    assert [h["kind"] for h in r["hints"]] == ["defer", "spawn", "branch", "branch", "wait", "branch", "return_handler"]
    assert {(f["struct"], f["field"], f["token"]) for f in r["fields"]} == {("S", "a", "h"), ("S", "b", "repo"), ("S", "c", "repo")}


def test_go_parser_survives_anything():
    for cut in range(0, len(GO), 7):
        parse(GO[:cut])
        parse(GO[cut:])
    parse(b"func ((((({{{{[[[ \xff\xfe `")
    parse(b"")


def test_go_columns_are_bytes():
    r = go_facts("u.go", 'package u\n\nfunc É() { é("ü"); f() }\n'.encode())
    assert r["symbols"][0]["name"] == "É" and r["symbols"][0]["start_line"] == 3 and r["symbols"][0]["end_byte"] == len('package u\n\nfunc É() { é("ü"); f() }'.encode())


def test_python():
    r = python_facts("p/m.py", b"from . import a as b\nimport os.path\nclass C:\n    def f(self):\n        self.g(b.x(1))\ndef test_q():\n    C()()\n")
    assert [(s["canonical_name"], s["kind"]) for s in r["symbols"]] == [("p.m.C", "class"), ("p.m.C.f", "method"), ("p.m.test_q", "test_function")]
    assert [(c["form"], c["operand"], c["name"]) for c in r["calls"]] == [("self", "self", "g"), ("member", "b", "x"), ("dynamic", "", ""), ("identifier", "", "C")]
    assert import_candidates("a/b/c.py", "d.e", 2) == ["a/d/e.py", "a/d/e/__init__.py"] and import_candidates("c.py", "d", 0) == ["d.py", "d/__init__.py"]
    broken = python_facts("x.py", b"def f(:\n  pass\nclass G:\n")
    assert [s["name"] for s in broken["symbols"]] == ["f", "G"] and not broken["calls"]


def test_python_that_does_not_parse_keeps_the_rest():
    r = python_facts("x.py", b"import a\nclass C:\n    def f(self):\n        self.g()\n    def h(self, :\n        a.b(1)\nx = = 2\ndef last():\n    run()\n")
    assert [(s["canonical_name"], s["kind"]) for s in r["symbols"]] == [("x.C", "class"), ("x.C.f", "method"), ("x.C.h", "method"), ("x.last", "function")]
    assert [(c["form"], c["name"]) for c in r["calls"]] == [("self", "g"), ("member", "b"), ("identifier", "run")]
    whole = b'import a\nclass C:\n    def f(self):\n        """doc"""\n        return [self.g(i) for i in range(3)]\n\t# x\n@d(1)\nasync def q(): await z()\n'
    for cut in range(0, len(whole), 3):
        python_facts("x.py", whole[:cut])


def test_calls_inside_template_literals():
    r = js_facts("a.js", b"function f() { return `t ${g(1)} u ${h(`in ${k()} {`)}` + m(); }\nfunction z() { y() }\n")
    assert [s["name"] for s in r["symbols"]] == ["f", "z"] and [c["name"] for c in r["calls"]] == ["g", "h", "k", "m", "y"]
    assert [c["name"] for c in js_facts("a.js", b"const f = () => { a(`{ ${ {x: 1}.x } }`); b() }")["calls"]] == ["a", "b"]
    for source in (b"`", b"`${", b"`${a", b"}`", b"`\\"):
        js_facts("a.js", source)


def test_typescript():
    r = js_facts("src/a.ts", b"""import d, {x as y, z} from "./lib/u"
import * as ns from '../k';
export class A extends B { m(a) { return this.n(y(1), /re(/); } static async n() {} }
export const f = async (q) => { z(q); ns.go(a.b.c()) };
export default function g() { h()() }
test("adds it", () => { f(1) })
export { f as ff, g }
""")
    assert [s["canonical_name"] for s in r["symbols"]] == ["src.a.A", "src.a.A.m", "src.a.A.n", "src.a.f", "src.a.g", "src.a.__test_adds_it_6"]
    assert [(c["form"], c["operand"], c["name"]) for c in r["calls"]] == [("self", "this", "n"), ("identifier", "", "y"), ("identifier", "", "z"), ("member", "ns", "go"), ("member", "a.b", "c"), ("dynamic", "", ""), ("identifier", "", "h"), ("identifier", "", "f")]
    assert {(i["alias"], i["imported_name"], i["is_namespace"]) for i in r["imports"]} == {("d", "default", False), ("y", "x", False), ("z", "z", False), ("ns", "", True)}
    assert ("default", "src.a.g") in {(e["name"], e["canonical_name"]) for e in r["exports"]}


ROUTES = b"""package api
import ("github.com/gin-gonic/gin"; "net/http"; "example.com/h"; "github.com/x/grpc-gateway/v2/runtime"; pb "example.com/pb")
type S struct { r *gin.RouterGroup; mux *http.ServeMux }
func NewS() *S { e := gin.New(); s := &S{r: e.Group("/api")}; s.mux = http.NewServeMux(); return s }
func (s *S) Routes(ctx Ctx) {
  v1 := s.r.Group("/v1")
  v1.GET("/users", s.list)
  { v2 := v1.Group("x"); v2.POST("", func(c *gin.Context) {}) }
  register(v1, listAll)
  s.mux.HandleFunc("/ping", ping)
  http.HandleFunc("/top", h.Serve)
  unknown.GET("/x", ping)
  gw := runtime.NewServeMux()
  if err := pb.RegisterEchoHandler(ctx, gw, conn); err != nil { return }
}
func (s *S) list(c *gin.Context) {}
func listAll(c *gin.Context) {}
func ping(w http.ResponseWriter, r *http.Request) {}
func register(g *gin.RouterGroup, h gin.HandlerFunc) { g.DELETE("//all", h); g.PUT(name, h); register(g, h) }
"""


def test_routes():
    found = package_routes([("api/a.go", ROUTES)])
    assert [(r["detector"], r["method"], r["path"], r["handler_target"]) for r in found if not r["category"]] == [
        ("gin", "GET", "/api/v1/users", "api.S.list"), ("gin", "POST", "/api/v1/x/", "api.S.Routes.$inline_handler_0"), ("gin", "DELETE", "/api/v1//all", "api.listAll"),
        ("nethttp", "ANY", "/ping", "ping"), ("nethttp", "ANY", "/top", "h.Serve"), ("gateway", "PROXY", "RegisterEchoHandler", "RegisterEchoHandler"),
    ]
    assert sorted(r["category"] for r in found if r["category"]) == ["boundary_nonliteral_path", "boundary_unproven_receiver"]


def routes(*files, imported=None):
    found = package_routes([(p, s.encode()) for p, s in files], imported)
    return {f"{r['method']} {r['path']}": r["handler_target"] for r in found if not r["category"]}, sorted(r["category"] for r in found if r["category"])


def test_routes_over_files_through_accessors_and_aliases():
    server = 'package web\nimport "github.com/gin-gonic/gin"\ntype app struct { e *gin.Engine }\nfunc build() *app { e := gin.Default(); return &app{e: e} }\nfunc (a *app) Root() *gin.Engine { return a.e }\n'
    router = """package web
import ("github.com/gin-gonic/gin"; "example.com/metrics")
type pages struct{}
func (pages) Show(*gin.Context) {}
func (pages) Make() gin.HandlerFunc { return func(c *gin.Context) {} }
func (a *app) wire() {
  root := a.Root()
  root.GET("/up", func(c *gin.Context) {})
  root.GET("/metrics", gin.WrapH(metrics.Handler()))
  one := root
  two := one
  g := one.Group("/a").Group("b")
  p := pages{}
  g.GET("/show", p.Show)
  g.POST("/make", p.Make())
  two.GET("/lost", p.Show)
  a.other().GET("/x", p.Show)
}
"""
    got, notes = routes(("s.go", server), ("r.go", router))
    assert got == {"GET /up": "web.app.wire.$inline_handler_0", "GET /metrics": "", "GET /a/b/show": "web.pages.Show", "POST /a/b/make": "web.pages.Make"}
    assert notes == ["boundary_unproven_receiver", "boundary_unresolved_handler_target", "boundary_unsupported_accessor_pattern"]


def test_handlers_of_other_packages_and_deep_providers():
    router = """package web
import ("github.com/gin-gonic/gin"; "example.com/cams"; "example.com/wrap")
type shower interface { Show(*gin.Context) }
func first() shower { return cams.NewCams() }
func second() shower { return first() }
func wire() {
  e := gin.New()
  a := cams.NewCams()
  b := a
  c := b
  d, f, g, h := first(), second(), wrap.Cameras(), wrap.Other()
  e.GET("/a", a.Show)
  e.GET("/b", b.Show)
  e.GET("/c", c.Show)
  e.GET("/d", d.Show())
  e.GET("/f", f.Show())
  e.GET("/g", g.Show)
  e.GET("/h", h.Show)
  e.Any("/any", cams.Free)
}
"""
    got, notes = routes(("r.go", router), imported={("wrap", "Cameras"): Handler("inner")})
    assert got == {"GET /a": "cams.Show", "GET /b": "cams.Show", "GET /c": "", "GET /d": "cams.Show", "GET /f": "", "GET /g": "inner.Show", "GET /h": "", "Any /any": ""}
    assert notes == ["boundary_unresolved_handler_target"] * 4
    wrap = 'package wrap\nimport in "example.com/wrap/inner"\ntype T struct{}\nfunc Cameras() X { return in.NewCams() }\nfunc Own() *T { return &T{} }\nfunc (t *T) M() *T { return &T{} }\nfunc Deep() *T { return Own() }\n'
    assert package_providers([("wrap/w.go", wrap.encode())]) == [("wrap", "Cameras", "in", ""), ("wrap", "Own", "wrap", "T")]


def test_mux_fields_by_their_declared_type():
    source = """package web
import ("net/http"; gw "github.com/grpc-ecosystem/grpc-gateway/v2/runtime")
type ServeMux struct{}
type mine struct { mux *ServeMux }
type server struct { mux, spare *http.ServeMux; gate *gw.ServeMux }
func made() http.HandlerFunc { return nil }
func (s *server) wire(ctx C) error {
  s.mux.HandleFunc("/field", list)
  s.spare.Handle("/spare", made())
  m := http.NewServeMux()
  n := m
  n.HandleFunc("/alias", pkg.list)
  l := mine{}
  l.mux.HandleFunc("/shadow", list)
  RegisterOneHandler(ctx, s.gate)
  go RegisterTwoHandlerFromEndpoint(ctx, s.gate, "x")
  RegisterThreeHandler(ctx, s.mux)
  RegisterFourHandler(ctx)
  var err = RegisterFiveHandler(ctx, s.gate)
  return RegisterSixHandler(ctx, s.gate)
}
"""
    got, notes = routes(("s.go", source))
    assert got == {"ANY /field": "list", "ANY /spare": "made", "ANY /alias": "pkg.list", **{f"PROXY Register{n}": f"Register{n}" for n in ("OneHandler", "TwoHandlerFromEndpoint", "FiveHandler", "SixHandler")}}
    assert notes == ["boundary_insufficient_args", "boundary_unproven_receiver", "boundary_unproven_receiver"]


def test_helpers_take_routers_and_handlers():
    source = """package web
import ("github.com/gin-gonic/gin"; h "example.com/handler")
func root(r *gin.Engine) { v := r.Group("/s/v1"); inner(v) }
func inner(g gin.IRoutes) { x := h.NewHandler(); g.POST("/p", x.Predict); deep(g, x) }
func deep(g gin.IRoutes, x h.Handler) { g.GET("/d", x.Show); inner(g) }
func main() { e := gin.New(); root(e); root(e) }
"""
    got, notes = routes(("m.go", source))
    assert got == {"POST /s/v1/p": "h.Predict", "GET /s/v1/d": "h.Show"} and notes == []


def test_providers_of_other_packages_where_all_agree(spark):
    tree = {
        "r/go.mod": "module example.com/r\n",
        "r/web/web.go": 'package web\nimport ("github.com/gin-gonic/gin"; "example.com/r/cam"; "example.com/r/two")\nfunc wire() { e := gin.New(); a := cam.Get(); b := two.Get(); e.GET("/a", a.Show); e.GET("/b", b.Show) }\n',
        "r/cam/cam.go": 'package cam\nimport "example.com/r/inner"\nfunc Get() X { return inner.NewX() }\n',
        "r/x/two/two.go": 'package two\nimport "example.com/r/inner"\nfunc Get() X { return inner.NewX() }\n',
        "r/y/two/two.go": 'package two\nimport "example.com/r/other"\nfunc Get() X { return other.NewX() }\n',
    }
    files = spark.createDataFrame([(p, t.encode()) for p, t in tree.items()], "relative_path string, content binary")
    built = index.index_workspace(staged(files, "tree"), "2024-01-01T00:00:00")
    assert {(r["path"], r["handler_target"]) for r in built["boundaries"].collect()} == {("/a", "inner.Show"), ("/b", "")}
    assert [r["category"] for r in built["diagnostics"].where("category like 'boundary%'").collect()] == ["boundary_unresolved_handler_target"]


def test_detectors_and_extractors_are_registries(spark):
    tree = {"r/go.mod": "module m\n", "r/a.go": 'package a\nimport "net/http"\nfunc wire() { http.HandleFunc("/x", list) }\n', "r/b.java": "class B {}\n"}
    files = staged(spark.createDataFrame([(p, t.encode()) for p, t in tree.items()], "relative_path string, content binary"), "tree")

    def second(sources, imported):
        return [r | {"detector": "again", "framework": "other"} for r in package_routes(sources, imported)]

    def java(path, source):
        place = {k: 1 for k in ("start_line", "start_col", "end_line", "end_col", "start_byte", "end_byte")}
        return {"package": "j", "symbols": [{"name": "B", "receiver": "", "canonical_name": "j.B", "kind": "class", "signature": "class B", "synthetic": False, **place}], "imports": [], "exports": [], "calls": [], "hints": [], "diagnostics": [], "fields": []}

    built = index.index_workspace(files, "2024-01-01T00:00:00", extractors={**EXTRACTORS, "java": java}, detectors={**DETECTORS, "again": second})
    assert {r["canonical_name"] for r in built["symbols"].collect()} == {"a.wire", "j.B"}
    assert [(r["framework"], r["path"]) for r in built["boundaries"].collect()] == [("other", "/x")]  # a tie goes to the first by name
    assert [r["category"] for r in built["diagnostics"].where("category like 'boundary%'").collect()] == ["boundary_ambiguity"]

    def broken(sources, imported):
        raise ValueError("no")

    built = index.index_workspace(files, "2024-01-01T00:00:00", detectors={"x": broken})
    assert [r["message"] for r in built["diagnostics"].where("category = 'boundary_detection_failed'").collect()] == ["ValueError: no"]
