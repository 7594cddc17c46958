"""A small workspace, inlined, whose facts are known by hand: the queries over it have their rows as SQL values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

WORKSPACE = {
    "svc/go.mod": "module example.com/one\n",
    "svc/Dockerfile": "FROM scratch\n",
    "svc/api/echo.proto": "syntax = 'proto3';\n",
    "svc/internal/helper/helper.go": "package helper\n\nfunc Transform(x string) string { return x }\n",
    "svc/internal/service/service.go": """package service

import (
	h "example.com/one/internal/helper"
	"sync"
)

type Server struct {
	helper *h.Client
	wg     sync.WaitGroup
}

func (s *Server) Handle(in string) func() {
	defer s.done()
	go func() { s.helper.Run(h.Transform(in)) }()
	if in == "" {
		s.wg.Wait()
	}
	return func() { stepOne(in) }
}

func (s *Server) done() {}

func stepOne(in string) string { return in }
""",
    "svc/internal/service/service_test.go": 'package service\n\nimport "testing"\n\nfunc TestHandle(t *testing.T) { stepOne("x") }\n',
    "svc/main.go": """package main

import (
	"net/http"

	"github.com/gin-gonic/gin"
)

func main() {
	http.HandleFunc("/ping", ping)
	e := gin.New()
	v1 := e.Group("/v1")
	v1.GET("/users", list)
	register(v1.Group("/x"), list)
	e.POST(name, list)
}

func register(g *gin.RouterGroup, h gin.HandlerFunc) { g.DELETE("/all", h) }

func ping(w http.ResponseWriter, r *http.Request) {}

func list(c *gin.Context) {}
""",
    "web/package.json": '{"scripts": {"start": "node src/index.js"}}',
    "web/src/index.js": 'import { go as run } from "./lib";\nimport ext from "ext";\nexport function main() { run(); ext(); missing.call(`${run()}`); }\n',
    "web/src/lib.js": "export function go() {}\nexport class A { b() { this.c(go()); } c(x) {} }\n",
    "web/app.py": "import pkg.util\nfrom pkg import util as u\n\ndef run():\n    pkg.util.work()\n    u.work()\n    run()()\n",
    "web/pkg/util.py": "class W:\n    def do(self):\n        self.do()\n\ndef work():\n    W()\n",
    "web/node_modules/x/skip.js": "export function skipped() {}\n",
}


def files(spark: SparkSession) -> DataFrame:
    """(relative_path, content), as a scan of the workspace gives them."""
    from pyspark.sql import functions as F

    from factgraph.operators.staging import staged
    from factgraph.sources.scan import IgnorePolicy

    rows = spark.createDataFrame([(p, t.encode()) for p, t in WORKSPACE.items()], "relative_path string, content binary")
    return staged(rows.where(~IgnorePolicy().ignores(F.col("relative_path"))), "workspace")


def rows_sql(columns: str, text: str) -> str:
    """SELECT of the rows of ``text``, one in a line with its values between bars; integers stay numbers, true and false are booleans, - is null."""
    lines = [[v.strip() for v in line.split("|")] for line in text.strip().split("\n")]
    value = lambda v: v if v.lstrip("-").isdigit() and v != "-" or v in ("true", "false") else "NULL" if v == "-" else "'" + v.replace("'", "''") + "'"
    number = lambda v: f"{value(v)}::BIGINT" if value(v) == v and v.isdigit() else value(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(number, v)) + ')' for v in lines)}) AS t({columns})"


SYMBOLS = """
internal/helper/helper.go | helper.Transform | | function | 3 | 1 | 3
internal/service/service.go | service.Server | | struct | 8 | 6 | 11
internal/service/service.go | service.Server.Handle | Server | method | 13 | 1 | 20
internal/service/service.go | service.Server.Handle.$closure_return_0 | | function | 19 | 9 | 19
internal/service/service.go | service.Server.Handle.$inline_handler_0 | | function | 15 | 5 | 15
internal/service/service.go | service.Server.done | Server | method | 22 | 1 | 22
internal/service/service.go | service.stepOne | | function | 24 | 1 | 24
internal/service/service_test.go | service.TestHandle | | test_function | 5 | 1 | 5
main.go | main.list | | function | 22 | 1 | 22
main.go | main.main | | function | 9 | 1 | 16
main.go | main.ping | | function | 20 | 1 | 20
main.go | main.register | | function | 18 | 1 | 18
app.py | app.run | | function | 4 | 1 | 7
pkg/util.py | pkg.util.W | | class | 1 | 1 | 3
pkg/util.py | pkg.util.W.do | W | method | 2 | 5 | 3
pkg/util.py | pkg.util.work | | function | 5 | 1 | 6
src/index.js | src.main | | function | 3 | 8 | 3
src/lib.js | src.lib.A | | class | 2 | 8 | 2
src/lib.js | src.lib.A.b | A | function | 2 | 18 | 2
src/lib.js | src.lib.A.c | A | function | 2 | 40 | 2
src/lib.js | src.lib.go | | function | 1 | 8 | 1
"""
IMPORTS = """
app.py | pkg | | | | false | false | false
app.py | pkg | u | util | | false | false | false
app.py | pkg.util | | | | false | false | false
app.py | pkg.util | pkg | | pkg/util.py | false | true | true
internal/service/service.go | example.com/one/internal/helper | | | | false | false | false
internal/service/service.go | example.com/one/internal/helper | h | | internal/helper/helper.go | false | true | true
internal/service/service.go | sync | | | | false | false | false
internal/service/service.go | sync | sync | | | false | true | false
internal/service/service_test.go | testing | | | | false | false | false
internal/service/service_test.go | testing | testing | | | false | true | false
main.go | github.com/gin-gonic/gin | | | | false | false | false
main.go | github.com/gin-gonic/gin | gin | | | false | true | false
main.go | net/http | | | | false | false | false
main.go | net/http | http | | | false | true | false
src/index.js | ./lib | | | | false | false | false
src/index.js | ./lib | run | go | src/lib.js | false | false | true
src/index.js | ext | | | | false | false | false
src/index.js | ext | ext | default | | true | false | false
"""
EXPORTS = """
app.py | run | app.run | false
pkg/util.py | W | pkg.util.W | false
pkg/util.py | work | pkg.util.work | false
src/index.js | main | src.main | false
src/lib.js | A | src.lib.A | false
src/lib.js | go | src.lib.go | false
"""
CALLS = """
app.run | app.run | app.run | app.py | | run | 90 | 0
app.run | pkg.util.work | pkg.util.work | pkg/util.py | work | pkg.util.work | 85 | 0
main.main | main.register | main.register | main.go | | register | 95 | 4
main.main | - | github.com/gin-gonic/gin.New | | | gin.New | 75 | 1
main.main | - | net/http.HandleFunc | | | http.HandleFunc | 75 | 0
pkg.util.W.do | pkg.util.W.do | pkg.util.W.do | pkg/util.py | | self.do | 85 | 0
pkg.util.work | pkg.util.W | pkg.util.W | pkg/util.py | | W | 90 | 0
service.Server.Handle | service.Server.done | service.Server.done | internal/service/service.go | | s.done | 90 | 0
service.Server.Handle | - | sync.Wait | | | s.wg.Wait | 70 | 2
service.Server.Handle.$closure_return_0 | service.stepOne | service.stepOne | internal/service/service.go | | stepOne | 95 | 0
service.Server.Handle.$inline_handler_0 | helper.Transform | example.com/one/internal/helper.Transform | internal/helper/helper.go | Transform | h.Transform | 75 | 1
service.Server.Handle.$inline_handler_0 | - | h.Run | | | s.helper.Run | 70 | 0
service.TestHandle | service.stepOne | service.stepOne | internal/service/service.go | | stepOne | 95 | 0
src.lib.A.b | src.lib.A.c | src.lib.A.c | src/lib.js | | this.c | 85 | 0
src.lib.A.b | src.lib.go | src.lib.go | src/lib.js | | go | 90 | 0
src.main | src.lib.go | src.lib.go | src/lib.js | go | run | 90 | 0
src.main | src.lib.go | src.lib.go | src/lib.js | go | run | 90 | 0
"""
HINTS = """
service.Server.Handle | service.Server.done | defer | defer s.done() | 0
service.Server.Handle | service.Server.Handle.$inline_handler_0 | spawn | go func() { s.helper.Run(h.Transform(in)) }() | 1
service.Server.Handle | service.Server.Handle | branch | if in == "" | 2
service.Server.Handle | service.Server.Handle | wait | s.wg.Wait() | 3
service.Server.Handle | service.Server.Handle.$closure_return_0 | return_handler | return func() { stepOne(in) } | 4
"""
DIAGNOSTICS = """
app.py | unresolved_import | u.work
app.py | unsupported_construct | run()
main.go | boundary_nonliteral_path | e.POST(name, list)
src/index.js | ambiguous_relation | missing.call
src/index.js | unresolved_import | ext
"""
BOUNDARIES = """
gin | DELETE | /v1/x/all | main.list | g.DELETE("/all", h)
gin | GET | /v1/users | main.list | v1.GET("/users", list)
net/http | ANY | /ping | ping | http.HandleFunc("/ping", ping)
"""
SERVICES = """
svc | svc | svc/main.go | grpc | service
web | web | web/app.py,web/package.json | | service
"""
FILES = """
Dockerfile | | |
api/echo.proto | | | config
app.py | python | app | python
go.mod | | |
internal/helper/helper.go | go | helper | go
internal/service/service.go | go | service | go
internal/service/service_test.go | go | service | go
main.go | go | main | go
package.json | json | | config
pkg/util.py | python | pkg.util | python
src/index.js | javascript | src | javascript
src/lib.js | javascript | src.lib | javascript
"""
