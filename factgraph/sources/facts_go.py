"""Raw facts of one Go file: symbols, imports, struct fields, calls, hints and route registrations."""

from __future__ import annotations

import re
from bisect import bisect_right

from factgraph.sources.go_syntax import Node, parse

ROUTE_METHODS = {"GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS", "Any"}


class GoFile:
    def __init__(self, path: str, source: bytes):
        self.path, self.source, self.root = path, source, parse(source)
        self.lines = [0, *(m.end() for m in re.finditer(b"\n", source))]
        package = next((n for n in self.root.children if n.kind == "package_clause"), None)
        self.package = self.text(package.parts["name"]) if package and "name" in package.parts else ""
        self.imports = {}
        for n in self.root.children:
            if n.kind == "import_spec" and "path" in n.parts:
                source_path = n.parts["path"].strip('"`')
                self.imports[n.parts.get("name") or source_path.rsplit("/", 1)[-1]] = source_path

    def text(self, n: Node | None) -> str:
        return "" if n is None else self.source[n.start : n.end].decode("utf-8", "replace")

    def flat(self, n: Node) -> str:
        return " ".join(self.text(n).split())

    def place(self, n: Node) -> dict:
        def at(offset: int) -> tuple[int, int]:
            row = bisect_right(self.lines, offset)
            return row, offset - self.lines[row - 1] + 1

        (a, b), (c, d) = at(n.start), at(n.end)
        return {"start_line": a, "start_col": b, "end_line": c, "end_col": d, "start_byte": n.start, "end_byte": n.end}


def bare(n: Node | None) -> Node | None:
    while n is not None and n.kind == "parenthesized_expression":
        n = n.parts.get("inner")
    return n


def type_token(f: GoFile, n: Node | None) -> str:
    """The package that a type's name belongs to."""
    while n is not None:
        if n.kind == "qualified_type":
            return n.parts["package"]
        n = n.parts.get("value") or n.parts.get("type")
    return f.package


def receiver_of(f: GoFile, d: Node) -> tuple[str, str]:
    """Name and type of a method's receiver."""
    for p in d.parts.get("receiver", []):
        kind = f.text(p.parts.get("type")).replace("*", "").split("[")[0].strip()
        return p.parts["name"], kind
    return "", ""


def callee(f: GoFile, fn: Node, receivers: dict[str, str]) -> dict | None:
    """What a called expression names: identifier; import, receiver or receiver-field selector; else nothing."""
    fn = bare(fn)
    if fn is None:
        return None
    if fn.kind == "identifier":
        return {"form": "identifier", "operand": "", "name": f.text(fn), "owner": ""}
    if fn.kind != "selector_expression" or "operand" not in fn.parts or "field" not in fn.parts:
        return None
    operand, name = fn.parts["operand"], f.text(fn.parts["field"])
    left = f.text(operand)
    if left in f.imports:
        return {"form": "import_selector", "operand": left, "name": name, "owner": f.imports[left]}
    if left in receivers:
        return {"form": "receiver_selector", "operand": left, "name": name, "owner": receivers[left]}
    inner = bare(operand)
    if inner is not None and inner.kind == "selector_expression" and "operand" in inner.parts and "field" in inner.parts and f.text(inner.parts["operand"]) in receivers:
        return {"form": "receiver_field_selector", "operand": f.text(inner.parts["field"]), "name": name, "owner": receivers[f.text(inner.parts["operand"])]}
    return None


def returned(n: Node) -> Node | None:
    values = n.parts.get("values") or []
    return values[0] if len(values) == 1 and values[0].kind == "func_literal" else None


def label(f: GoFile, n: Node, name: str) -> str:
    found = n.parts.get(name) or (n.children[0] if n.children else None)
    return f.flat(found) if found is not None else "unknown"


def declaration_facts(f: GoFile, d: Node, out: dict) -> None:
    name = f.text(d.parts.get("name"))
    alias, receiver = receiver_of(f, d) if d.kind == "method_declaration" else ("", "")
    canonical = ".".join(x for x in (f.package, receiver, name) if x)
    kind = "test_function" if name.startswith("Test") else "method" if receiver else "function"
    own = len(out["symbols"])
    out["symbols"].append({"name": name, "receiver": receiver, "canonical_name": canonical, "kind": kind, "signature": f.text(d).strip(), "synthetic": False, **f.place(d)})
    body = d.parts.get("body")
    if body is None:
        return
    receivers = {alias: receiver} if alias and receiver else {}
    nodes = list(body.walk())
    returns = {id(x) for n in nodes if n.kind == "return_statement" and (x := returned(n)) is not None}
    scopes: list[tuple[int, int, int]] = []
    named: dict[int, int] = {}
    counts = {True: 0, False: 0}
    for n in nodes:
        if n.kind == "func_literal":
            closure = id(n) in returns
            label_ = f"${'closure_return' if closure else 'inline_handler'}_{counts[closure]}"
            counts[closure] += 1
            named[id(n)] = len(out["symbols"])
            scopes.append((n.start, n.end, len(out["symbols"])))
            out["symbols"].append({"name": label_, "receiver": "", "canonical_name": f"{canonical}.{label_}", "kind": "function", "signature": "func()" if closure else "func(...)", "synthetic": True, **f.place(n)})
    inside = [n for n in nodes if not any(s < n.start and n.end <= e or s <= n.start and n.end < e for s, e, _ in scopes)]
    hints: list[tuple] = []
    for n in inside:
        target, target_name, what, evidence = own, canonical, "branch", ""
        if n.kind == "return_statement":
            lit = returned(n)
            if lit is None:
                continue
            target, what, evidence = named[id(lit)], "return_handler", f.flat(n)
            target_name = out["symbols"][target]["canonical_name"]
        elif n.kind in ("go_statement", "defer_statement"):
            call = n.parts.get("call")
            if call is None or call.kind != "call_expression":
                continue
            fn, what, evidence = call.parts["function"], "spawn" if n.kind == "go_statement" else "defer", f.flat(n)
            if fn.kind == "func_literal":
                target = named[id(fn)]
                target_name = out["symbols"][target]["canonical_name"]
            else:
                found = callee(f, fn, receivers)
                if found is None:
                    continue
                target, target_name = None, target_of(f, found)
        elif n.kind == "call_expression":
            fn = bare(n.parts["function"])
            if fn is None or fn.kind != "selector_expression" or f.text(fn.parts.get("field")) != "Wait" or n.parts["arguments"]:
                continue
            what, evidence = "wait", f.flat(n)
        elif n.kind == "if_statement":
            evidence = "if " + label(f, n, "condition")
        elif n.kind in ("expression_switch_statement", "type_switch_statement"):
            evidence = "switch " + label(f, n, "value")
        elif n.kind == "for_statement":
            evidence = f"for loop at line line {f.place(n)['start_line']}"  # doubled word kept: stored evidence has it
        else:
            continue
        hints.append((n.start, what, evidence, target, target_name))
    for order, (_, what, evidence, target, target_name) in enumerate(sorted(hints, key=lambda h: (h[0], h[1], h[2]))):
        out["hints"].append({"symbol": own, "target": target, "target_symbol": target_name, "kind": what, "evidence": evidence, "order_index": order})
    orders: dict[int, int] = {}
    for n in nodes:
        if n.kind != "call_expression":
            continue
        around = [(e - s, k) for s, e, k in scopes if s <= n.start and n.end <= e]
        active = min(around)[1] if around else own
        order = orders[active] = orders.get(active, -1) + 1
        found = callee(f, n.parts["function"], receivers)
        if found is not None:
            out["calls"].append({"symbol": active, "order_index": order, "evidence": f.text(n.parts["function"]).strip(), **found})


def target_of(f: GoFile, found: dict) -> str:
    if found["form"] == "identifier":
        return f"{f.package}.{found['name']}"
    if found["form"] == "import_selector":
        return f"{found['owner']}.{found['name']}"
    return ".".join((f.package, found["owner"], found["name"]) if found["form"] == "receiver_selector" else (found["operand"], found["name"]))


def go_facts(path: str, source: bytes) -> dict:
    f = GoFile(path, source)
    out: dict = {"package": f.package, "symbols": [], "imports": [], "exports": [], "calls": [], "hints": [], "diagnostics": [], "fields": []}
    for n in f.root.walk():
        if n.kind == "import_spec" and "path" in n.parts:
            p = n.parts["path"].strip('"`')
            out["imports"].append({"source": p, "alias": n.parts.get("name") or p.rsplit("/", 1)[-1], "imported_name": "", "export_name": "", "is_default": False, "is_namespace": True, "candidates": []})
        elif n.kind in ("function_declaration", "method_declaration"):
            declaration_facts(f, n, out)
        elif n.kind == "type_spec" and "name" in n.parts:
            name, kind = f.text(n.parts["name"]), n.parts.get("type")
            out["symbols"].append({"name": name, "receiver": "", "canonical_name": f"{f.package}.{name}", "kind": "interface" if kind is not None and kind.kind == "interface_type" else "struct", "signature": f.text(n).strip(), "synthetic": False, **f.place(n)})
            if kind is not None and kind.kind == "struct_type":
                for d in kind.walk():
                    if d.kind == "field_declaration":
                        for x in d.parts["names"]:
                            out["fields"].append({"struct": name, "field": x, "token": type_token(f, d.parts.get("type"))})
    return out
