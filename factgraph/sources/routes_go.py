"""Route registrations in Go packages: gin routers, net/http multiplexers and gRPC gateways.

A package is interpreted by blocks, with three kinds of values. A *router* is a framework with a path prefix; it
comes from a constructor call, a parameter type, a struct field, a provider function or method of the package,
or a ``Group`` call on another router. A *handler* is an object whose methods serve routes: a package and, where it
is this package's, a type; it comes from a literal, a provider, or a constructor of another package. A *receiver*
is a variable of a type of the package. Assignments carry all three; an alias of an alias is no longer followed,
nor a provider that returns another provider's result.

Preparation runs over all bodies until fields and providers settle, three times at most; detection then reads
route calls. What functions of other packages return is prepared for all packages first, and taken where all
packages of that name agree. Calls of package functions that take a router are entered with their arguments, to
a depth of three and never recursively. Receivers that are not proven to be routers give a diagnostic, not a route.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.functions import scalars as S
from factgraph.operators.dedup import winner
from factgraph.operators.staging import staged
from factgraph.sources.facts_go import ROUTE_METHODS, GoFile, bare, go_facts, receiver_of
from factgraph.sources.go_syntax import Node
from factgraph.sources.scan import folder

GIN = "github.com/gin-gonic/gin"
ROUTER_TYPES = {"Engine", "RouterGroup", "IRouter", "IRoutes"}
GATEWAY = re.compile(r"^Register.*(Handler|HandlerServer|HandlerClient|HandlerFromEndpoint)$")
CANDIDATE = "gin|http|mux|HandleFunc|Group|grpc|Register"
CONSTRUCTOR = re.compile("New|Make|Create|Build|Init")
MAX_DEPTH, MAX_PASSES = 3, 3
ROOTS = "repository_id string, detector string, kind string, framework string, method string, path string, canonical_name string, handler_target string, source_file string, source_expr string, source_start_byte long, source_end_byte long, confidence string, category string, message string"


@dataclass(frozen=True)
class Router:
    framework: str  # gin, nethttp or gateway
    prefix: str = ""
    depth: int = 0  # aliases on the way


@dataclass(frozen=True)
class Handler:
    token: str  # the package's name
    type: str = ""  # of this package only
    depth: int = 0


@dataclass
class Package:
    files: list[GoFile]
    fields: dict[tuple[str, str], Router] = field(default_factory=dict)
    imported: dict[tuple[str, str], Handler] = field(default_factory=dict)  # by package and function, of other packages
    providers: dict[tuple[str, str], Router] = field(default_factory=dict)
    handlers: dict[tuple[str, str], Handler] = field(default_factory=dict)  # what functions and methods return

    def __post_init__(self):
        self.functions: dict[tuple[str, str], list[tuple[GoFile, Node]]] = {}
        for f in self.files:
            for d in f.root.walk():
                if d.kind in ("function_declaration", "method_declaration"):
                    receiver = receiver_of(f, d)[1] if d.kind == "method_declaration" else ""
                    self.functions.setdefault((receiver, f.text(d.parts.get("name"))), []).append((f, d))
                elif d.kind == "type_spec" and (struct := d.parts.get("type")) is not None and struct.kind == "struct_type":
                    for names, kind in struct_fields(f, struct):
                        r = typed_router(f, kind)
                        if r is not None and r.framework != "gin":
                            self.fields.update({(f.text(d.parts.get("name")), n): r for n in names})
        self.names = {f.path: {x["start_byte"]: x["canonical_name"] for x in go_facts(f.path, f.source)["symbols"] if x["synthetic"]} for f in self.files}

    def only(self, receiver: str, name: str) -> tuple[GoFile, Node] | None:
        found = self.functions.get((receiver, name), [])
        return found[0] if len(found) == 1 else None


def clean_path(p: str) -> str:
    p = p.replace("//", "/")
    return p if p.startswith("/") else "/" + p


def literal(f: GoFile, e: Node) -> str:
    return f.text(e).strip('"`')


def struct_fields(f: GoFile, struct: Node) -> Iterator[tuple[list[str], str]]:
    """Names and type text of each field of a struct."""
    for d in struct.walk():
        if d.kind == "field_declaration":
            yield d.parts["names"], f.text(d.parts.get("type"))


def imported(f: GoFile, alias: str, path: str) -> bool:
    return f.imports.get(alias) == path


def is_gateway(f: GoFile, alias: str) -> bool:
    p = f.imports.get(alias, "")
    return "grpc-gateway" in p and p.endswith("/runtime")


def typed_router(f: GoFile, text: str) -> Router | None:
    alias, _, name = re.sub(r"^[*\[\]]+", "", text).split("[")[0].partition(".")
    if name in ROUTER_TYPES and imported(f, alias, GIN):
        return Router("gin")
    if name == "ServeMux":
        return Router("nethttp") if imported(f, alias, "net/http") else Router("gateway") if is_gateway(f, alias) else None
    return None


class Body:
    """Interpretation of one function body. ``out`` is None while a package is prepared."""

    def __init__(self, package: Package, f: GoFile, d: Node, out: list[dict] | None, routers: dict[str, Router] | None = None, handlers: dict[str, Handler] | None = None, targets: dict[str, str] | None = None, receivers: dict[str, str] | None = None, frames: tuple = ()):
        self.package, self.f, self.d, self.out, self.frames = package, f, d, out, frames
        self.kinds = {"gin"} if frames else {"gin", "nethttp", "gateway"}
        alias, self.receiver = receiver_of(f, d) if d.kind == "method_declaration" else ("", "")
        self.receivers = {alias: self.receiver} if alias else {}
        self.handlers, self.targets, self.scope = dict(handlers or {}), dict(targets or {}), dict(routers or {})
        self.takes_router = False
        for p in d.parts.get("parameters", []):
            text = f.text(p.parts.get("type"))
            if (r := typed_router(f, text)) is not None:
                self.takes_router |= r.framework == "gin"
                self.scope.setdefault(p.parts["name"], r)
            elif re.fullmatch(r"\*?\w+", text):
                self.receivers.setdefault(p.parts["name"], text.lstrip("*"))
        self.receivers.update(receivers or {})

    def run(self) -> None:
        if (body := self.d.parts.get("body")) is not None:
            self.block(body, dict(self.scope), dict(self.receivers), dict(self.handlers))

    # -- values
    def router(self, e: Node | None, scope: dict[str, Router], receivers: dict[str, str], depth: int = 0) -> Router | None:
        """The router that an expression is; ``depth`` 1 inside a provider's own return."""
        f, e = self.f, bare(e)
        if e is None:
            return None
        if e.kind == "identifier":
            return scope.get(f.text(e))
        if e.kind == "unary_expression":
            return self.router(e.parts.get("operand"), scope, receivers, depth)
        if e.kind == "selector_expression" and "operand" in e.parts:
            owner = receivers.get(f.text(e.parts["operand"]))
            return self.package.fields.get((owner, f.text(e.parts.get("field")))) if owner else None
        if e.kind != "call_expression":
            return None
        fn, args = bare(e.parts["function"]), e.parts["arguments"]
        if fn is None:
            return None
        if fn.kind == "identifier":
            return self.package.providers.get(("", f.text(fn))) if not args and depth < 1 else None
        if fn.kind != "selector_expression" or "operand" not in fn.parts:
            return None
        left, name = f.text(fn.parts["operand"]), f.text(fn.parts.get("field"))
        if name in ("New", "Default"):
            return Router("gin") if left == "gin" or imported(f, left, GIN) else None
        if name == "NewServeMux":
            return Router("nethttp") if imported(f, left, "net/http") else Router("gateway") if is_gateway(f, left) else None
        if name == "Group":
            base = self.router(fn.parts["operand"], scope, receivers, depth)
            if base is None or base.framework != "gin" or not args or args[0].kind != "string_literal":
                return None
            return Router("gin", clean_path(f"{base.prefix}/{literal(f, args[0])}"))
        if args or depth >= 1 or left not in receivers:
            return None
        return self.package.providers.get((receivers[left], name))

    def handler(self, e: Node | None, handlers: dict[str, Handler], receivers: dict[str, str], depth: int = 0) -> Handler | None:
        """The object with route methods that an expression is."""
        f, e = self.f, bare(e)
        if e is None:
            return None
        if e.kind == "identifier":
            return handlers.get(f.text(e))
        if e.kind == "composite_literal":
            kind = f.text(e.parts.get("type")).split("[")[0]
            return Handler(f.package, kind) if kind.isidentifier() else None
        if e.kind == "unary_expression":
            return self.handler(e.parts.get("operand"), handlers, receivers, depth)
        if e.kind != "call_expression" or (fn := bare(e.parts["function"])) is None:
            return None
        if fn.kind == "identifier":
            return self.package.handlers.get(("", f.text(fn))) if depth < 1 else None
        if fn.kind != "selector_expression" or "operand" not in fn.parts:
            return None
        left, name = f.text(fn.parts["operand"]), f.text(fn.parts.get("field"))
        if left in f.imports:
            if (found := self.package.imported.get((left, name))) is not None:
                return found
            if CONSTRUCTOR.match(name):
                return Handler(left)
        return self.package.handlers.get((receivers[left], name)) if depth < 1 and left in receivers else None

    def assigned(self, e: Node, scope: dict[str, Router], receivers: dict[str, str], handlers: dict[str, Handler]) -> tuple[Router | None, Handler | None]:
        """The router and the handler that a variable gets; an alias of an alias gets neither."""
        r, h = self.router(e, scope, receivers), self.handler(e, handlers, receivers)
        if (inner := bare(e)) is not None and inner.kind == "identifier":
            r = None if r is None or r.depth else replace(r, depth=1)
            return r, None if h is None or h.depth else replace(h, depth=1)
        return r and replace(r, depth=0), h and replace(h, depth=0)

    # -- statements
    def block(self, block: Node, scope: dict[str, Router], receivers: dict[str, str], handlers: dict[str, Handler]) -> None:
        for s in block.children:
            self.bind(s, scope, receivers, handlers)
            if s.kind == "return_statement" and s.parts.get("values") and self.d.kind != "func_literal":
                name = (self.receiver, self.f.text(self.d.parts.get("name")))
                if (r := self.router(s.parts["values"][0], scope, receivers, 1)) is not None:
                    self.package.providers[name] = replace(r, depth=0)
                if (h := self.handler(s.parts["values"][0], handlers, receivers, 1)) is not None and h.token:
                    self.package.handlers[name] = replace(h, depth=0)
            if self.out is not None:
                for call in self.calls(s):
                    self.route(call, scope, receivers, handlers)
                    if "gin" in self.kinds:
                        self.enter(call, scope, receivers, handlers)
            for inner in self.blocks(s):
                self.block(inner, dict(scope), dict(receivers), dict(handlers))

    def blocks(self, s: Node) -> Iterator[Node]:
        for c in s.children:
            if c.kind == "block":
                yield c
            elif c.kind in ("if_statement", "labeled_statement"):
                yield from self.blocks(c)
        if s.kind == "block":
            yield s

    def calls(self, s: Node) -> list[Node]:
        if s.kind in ("go_statement", "defer_statement"):
            found = [s.parts.get("call")]
        elif s.kind == "expression_statement":
            found = s.children
        elif s.kind in ("short_var_declaration", "assignment_statement"):
            found = s.parts.get("right", [])
        elif s.kind == "return_statement":
            found = s.parts.get("values", [])
        elif s.kind == "var_declaration":
            found = [e for v in s.children for e in v.parts.get("right", [])]
        elif s.kind == "if_statement":
            found = [e for c in s.children if c.kind == "short_var_declaration" for e in c.parts.get("right", [])]
        else:
            found = []
        return [x for x in map(bare, found) if x is not None and x.kind == "call_expression"]

    def bind(self, s: Node, scope: dict[str, Router], receivers: dict[str, str], handlers: dict[str, Handler]) -> None:
        f = self.f
        pairs: list[tuple[Node, Node]] = []
        for n in (s, *s.children) if s.kind in ("var_declaration", "if_statement") else (s,):
            if n.kind in ("short_var_declaration", "assignment_statement", "var_spec"):
                pairs += list(zip(n.parts.get("left", []), n.parts.get("right", []), strict=False))
                if n.kind == "var_spec" and "type" in n.parts and not n.parts.get("right"):
                    for x in n.parts["left"]:
                        if (r := typed_router(f, f.text(n.parts["type"]))) is not None:
                            scope[f.text(x)] = r
                        elif re.fullmatch(r"\*?\w+", t := f.text(n.parts["type"])):
                            receivers[f.text(x)] = t.lstrip("*")
        for left, right in pairs:
            name = f.text(left)
            r, h = self.assigned(right, scope, receivers, handlers)
            if left.kind == "identifier":
                kind = receivers.get(f.text(bare(right)) if bare(right) is not None and bare(right).kind == "identifier" else "")
                for table, value in ((scope, r), (handlers, h), (receivers, kind)):
                    if value is not None:
                        table[name] = value
                    else:
                        table.pop(name, None)
            elif left.kind == "selector_expression" and r is not None and (owner := self.local_type(left.parts.get("operand"), receivers, handlers)):
                self.package.fields[owner, f.text(left.parts.get("field"))] = replace(r, depth=0)
        for n in s.walk():
            if n.kind == "composite_literal" and (owner := f.text(n.parts.get("type"))).isidentifier():
                for key, value in n.parts["elements"]:
                    if key is not None and (r := self.router(value, scope, receivers)) is not None:
                        self.package.fields[owner, f.text(key)] = replace(r, depth=0)

    def local_type(self, e: Node | None, receivers: dict[str, str], handlers: dict[str, Handler]) -> str:
        """The type of this package that an expression has."""
        e = bare(e)
        if e is None:
            return ""
        if e.kind == "identifier":
            name = self.f.text(e)
            h = handlers.get(name)
            return receivers.get(name) or (h.type if h is not None and h.token == self.f.package else "")
        if e.kind == "composite_literal":
            kind = self.f.text(e.parts.get("type")).split("[")[0]
            return kind if kind.isidentifier() else ""
        return self.local_type(e.parts.get("operand"), receivers, handlers) if e.kind == "unary_expression" else ""

    # -- routes
    def target(self, e: Node | None, receivers: dict[str, str], handlers: dict[str, Handler]) -> str:
        """The function that serves a gin route, '' if it is not known for certain."""
        f, e = self.f, bare(e)
        if e is None:
            return ""
        if e.kind == "func_literal":
            return self.package.names[f.path].get(e.start, "")
        if e.kind == "identifier":
            name = f.text(e)
            return self.targets.get(name) or (f"{f.package}.{name}" if self.package.only("", name) else "")
        if e.kind == "call_expression":
            fn = bare(e.parts["function"])
            return self.target(fn, receivers, handlers) if fn is not None and fn.kind in ("identifier", "selector_expression") else ""
        if e.kind != "selector_expression" or "operand" not in e.parts:
            return ""
        name = f.text(e.parts.get("field"))
        if kind := self.local_type(e.parts["operand"], receivers, handlers):
            return f"{f.package}.{kind}.{name}" if self.package.only(kind, name) else ""
        left = bare(e.parts["operand"])
        h = handlers.get(f.text(left)) if left is not None and left.kind == "identifier" else None
        return f"{h.token.rsplit('.', 1)[-1]}.{name}" if h is not None else ""

    def text_target(self, e: Node | None) -> str:
        """The handler of a net/http route: a literal's own symbol, else the text of what is named or called."""
        e = bare(e)
        if e is None:
            return ""
        if e.kind == "func_literal":
            return self.package.names[self.f.path].get(e.start, "") or self.f.text(e)
        if e.kind == "call_expression" and (fn := bare(e.parts["function"])) is not None and fn.kind in ("identifier", "selector_expression"):
            return self.f.text(fn)
        return self.f.text(e)

    def emit(self, call: Node, detector: str, method: str = "", path: str = "", target: str = "", category: str = "", message: str = "") -> None:
        kind = {"gateway": "http_gateway"}.get(detector, "http")
        self.out.append({"detector": detector, "kind": kind, "framework": {"nethttp": "net/http", "gateway": "grpc-gateway"}.get(detector, detector), "method": method, "path": path, "canonical_name": f"{method} {path}" if not category else "", "handler_target": target, "source_file": self.f.path, "source_expr": self.f.text(call), "source_start_byte": call.start, "source_end_byte": call.end, "confidence": "high", "category": category and f"boundary_{category}", "message": message})

    def route(self, call: Node, scope: dict[str, Router], receivers: dict[str, str], handlers: dict[str, Handler]) -> None:
        fn, args, f = bare(call.parts["function"]), call.parts["arguments"], self.f
        if fn is None:
            return
        method = f.text(fn if fn.kind == "identifier" else fn.parts.get("field")) if fn.kind in ("identifier", "selector_expression") else ""
        if GATEWAY.match(method) and "gateway" in self.kinds:
            mux = self.router(args[1], scope, receivers) if len(args) > 1 else None
            if len(args) < 2:
                self.emit(call, "gateway", category="insufficient_args", message=f"{method} needs a gateway mux")
            elif mux is None or mux.framework != "gateway":
                self.emit(call, "gateway", category="unproven_receiver", message=f"the mux of {method} is not proven")
            else:
                self.emit(call, "gateway", "PROXY", method, method)
            return
        if fn.kind != "selector_expression" or "operand" not in fn.parts:
            return
        operand = bare(fn.parts["operand"])
        router = self.router(operand, scope, receivers)
        if method in ("HandleFunc", "Handle") and "nethttp" in self.kinds:
            detector, proven = "nethttp", router is not None and router.framework == "nethttp" or imported(f, f.text(operand), "net/http")
        elif method in ROUTE_METHODS and "gin" in self.kinds:
            detector, proven = "gin", router is not None and router.framework == "gin"
        else:
            return
        if not proven:
            accessor = detector == "gin" and operand is not None and operand.kind == "call_expression"
            self.emit(call, detector, category="unsupported_accessor_pattern" if accessor else "unproven_receiver", message=f"the receiver of {method} is not proven to be a router")
        elif len(args) < 2:
            self.emit(call, detector, category="insufficient_args", message=f"{method} needs a path and a handler")
        elif args[0].kind != "string_literal":
            self.emit(call, detector, category="nonliteral_path", message=f"the path of {method} is not a literal")
        elif detector == "nethttp":
            self.emit(call, detector, "ANY", clean_path(literal(f, args[0])), self.text_target(args[-1]))
        else:
            path, target = clean_path(f"{router.prefix}/{literal(f, args[0])}"), self.target(args[-1], receivers, handlers)
            self.emit(call, detector, method, path, target)
            if not target:
                self.emit(call, detector, category="unresolved_handler_target", message=f"the handler of {method} {path} is not known for certain")

    def enter(self, call: Node, scope: dict[str, Router], receivers: dict[str, str], handlers: dict[str, Handler]) -> None:
        """Interpret a package function that gets a router."""
        fn = bare(call.parts["function"])
        if fn is None or len(self.frames) >= MAX_DEPTH:
            return
        found = None
        if fn.kind == "identifier":
            found = self.package.only("", self.f.text(fn))
        elif fn.kind == "selector_expression" and (owner := self.local_type(fn.parts.get("operand"), receivers, handlers)):
            found = self.package.only(owner, self.f.text(fn.parts.get("field")))
        if found is None:
            return
        f, d = found
        bound: dict[str, Router] = {}
        objects: dict[str, Handler] = {}
        targets: dict[str, str] = {}
        types: dict[str, str] = {}
        for p, a in zip(d.parts.get("parameters", []), call.parts["arguments"], strict=False):
            name, r = p.parts["name"], self.router(a, scope, receivers)
            if r is not None and r.framework == "gin" and typed_router(f, f.text(p.parts.get("type"))) is not None:
                bound[name] = Router("gin", r.prefix)
                continue
            if (h := self.assigned(a, scope, receivers, handlers)[1]) is not None:
                objects[name] = h
            elif target := self.target(a, receivers, handlers):
                targets[name] = target
            if (inner := bare(a)) is not None and inner.kind == "identifier" and self.f.text(inner) in receivers:
                types[name] = receivers[self.f.text(inner)]
        frame = (id(d), tuple(sorted((k, v.prefix) for k, v in bound.items())), tuple(sorted((k, v.token, v.type) for k, v in objects.items())), tuple(sorted(targets.items())))
        if bound and frame not in self.frames:
            Body(self.package, f, d, self.out, bound, objects, targets, types, (*self.frames, frame)).run()


def prepared(files: list[tuple[str, bytes]], imported: dict[tuple[str, str], Handler] | None = None) -> Package:
    package = Package([GoFile(p, s) for p, s in sorted(files)], imported=dict(imported or {}))
    for _ in range(MAX_PASSES):
        before = (dict(package.fields), dict(package.providers), dict(package.handlers))
        for found in package.functions.values():
            for f, d in found:
                Body(package, f, d, None).run()
        if before == (package.fields, package.providers, package.handlers):
            break
    return package


def package_providers(files: list[tuple[str, bytes]]) -> list[tuple[str, str, str, str]]:
    """(package, function, package and type of the handler that it returns) of one package."""
    package = prepared(files)
    token = package.files[0].package if package.files else ""
    return sorted((token, name, h.token, h.type) for (receiver, name), h in package.handlers.items() if not receiver)


def package_routes(files: list[tuple[str, bytes]], imported: dict[tuple[str, str], Handler] | None = None) -> list[dict]:
    package = prepared(files, imported)
    out: list[dict] = []
    for f in package.files:
        if not re.search(CANDIDATE.encode(), f.source):
            continue
        for d in top_functions(f.root):
            body = Body(package, f, d, out)
            body.kinds = {"nethttp", "gateway"} if body.takes_router else {"gin", "nethttp", "gateway"}
            body.run()
    return out


def top_functions(node: Node) -> Iterator[Node]:
    """Functions, methods and function literals that are inside no other."""
    if node.kind in ("function_declaration", "method_declaration", "func_literal"):
        yield node
        return
    for c in sorted(node.children, key=lambda x: x.start):
        yield from top_functions(c)


#: Registry of detectors: (files of a package, handlers of imported functions) to rows like those of ``package_routes``. Roots of all are united; of one route the best wins.
DETECTORS: dict[str, Callable[[list[tuple[str, bytes]], dict[tuple[str, str], Handler]], list[dict]]] = {"go-routes": package_routes}
PROVIDERS = "repository_id string, token string, name string, to_token string, to_type string"


def detect_routes(files: DataFrame, packages: DataFrame, imports: DataFrame, detectors: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(boundaries, diagnostics) of a files table; ``packages``: repository_id, path, package_name; ``imports``: repository_id, path, alias.

    Whole packages that hold no candidate word are left out before any parsing; the others are grouped by
    repository, folder and package, which bounds a group by one package's sources. Before them, packages whose
    name a candidate imports are read for what their functions return.
    """
    go = files.where((F.col("language") == "go") & ~F.endswith("path", F.lit("_test.go"))).join(packages, ["repository_id", "path"]).withColumn("dir", folder(F.col("path")))
    key = ["repository_id", "dir", "package_name"]
    wanted = go.groupBy(*key).agg(F.bool_or(F.regexp_like(F.decode("content", "UTF-8"), F.lit(CANDIDATE))).alias("hit")).where("hit").drop("hit")
    candidates = go.join(wanted, key).select(*key, "path", "content")
    tokens = candidates.drop("content").join(imports.select("repository_id", "path", F.col("alias").alias("token")), ["repository_id", "path"]).select(*key, "token").distinct()

    def prepare(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        try:
            rows = package_providers([(p, bytes(c)) for p, c in zip(frame["path"], frame["content"], strict=True)])
        except (RecursionError, ValueError, KeyError, IndexError, AttributeError):  # detection reports it
            rows = []
        return pd.DataFrame([(keys[0], *r) for r in rows], columns=[x.split(" ")[0] for x in PROVIDERS.split(", ")])

    needed = go.join(tokens.select("repository_id", F.col("token").alias("package_name")).distinct(), ["repository_id", "package_name"], "left_semi")
    found = needed.select(*key, "path", "content").groupBy(*key).applyInPandas(prepare, PROVIDERS)
    target = F.struct("to_token", "to_type")
    agreed = found.groupBy("repository_id", "token", "name").agg(F.min(target).alias("lo"), F.max(target).alias("hi")).where("lo = hi").select("repository_id", "token", "name", "lo.*")
    given = staged(tokens.join(agreed, ["repository_id", "token"]), "providers")
    names = [x.split(" ")[0] for x in ROOTS.split(", ")]
    chosen = DETECTORS if detectors is None else detectors

    def run(keys: tuple, frame: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        imported = {(t, n): Handler(a, b) for t, n, a, b in zip(known["token"], known["name"], known["to_token"], known["to_type"], strict=True)}
        try:
            sources = [(p, bytes(c)) for p, c in zip(frame["path"], frame["content"], strict=True)]
            rows = [r for detect in chosen.values() for r in detect(sources, imported)]
        except (RecursionError, ValueError, KeyError, IndexError, AttributeError) as e:
            rows = [dict.fromkeys(names, "") | {"source_file": min(frame["path"], default=""), "source_start_byte": 0, "source_end_byte": 0, "category": "boundary_detection_failed", "message": f"{type(e).__name__}: {e}"}]
        return pd.DataFrame([{**r, "repository_id": keys[0]} for r in rows if len(frame)], columns=names)

    found = staged(candidates.groupBy(*key).cogroup(given.groupBy(*key)).applyInPandas(run, ROOTS), "routes")
    roots = found.where("category = ''").distinct()
    same = ["repository_id", "source_file", "source_start_byte", "source_end_byte", "method", "path", "handler_target"]
    ranking = [-S.confidence_rank(F.col("confidence")), F.col("handler_target") == "", F.col("detector"), F.col("canonical_name")]
    best = winner(roots, same, ranking)
    id_ = S.stable_id("boundary", F.col("repository_id"), F.col("source_file"), F.col("source_start_byte"), F.col("source_end_byte"), F.col("framework"), F.col("method"), F.col("path"))
    boundaries = best.select(id_.alias("id"), "repository_id", "kind", "framework", "method", "path", "canonical_name", "source_file", "source_expr", "handler_target", "source_start_byte", "source_end_byte")
    tied = roots.groupBy(*same, "confidence").agg(F.min("detector").alias("lo"), F.max("detector").alias("hi"), F.min("source_expr").alias("source_expr")).where("lo <> hi")
    tied = tied.select("repository_id", "source_file", F.lit("boundary_ambiguity").alias("category"), F.concat(F.lit("detectors "), "lo", F.lit(" and "), "hi", F.lit(" report one route with confidence "), "confidence", F.lit("; the first stays")).alias("message"), "source_expr")
    notes = found.where("category <> ''").select("repository_id", "source_file", "category", "message", "source_expr").unionByName(tied).distinct()
    diagnostics = notes.select(S.stable_id("bd", F.lit("diag"), *[F.col(c) for c in notes.columns]).alias("id"), F.col("source_file").alias("file_path"), F.lit("").alias("symbol_id"), "category", "message", F.col("source_expr").alias("evidence"))
    return boundaries, diagnostics
