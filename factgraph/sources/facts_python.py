"""Raw facts of one Python file, from its syntax tree.

Lines that do not parse are taken out one by one (the header of a definition is completed instead) until the
rest parses; if nothing helps, definitions are found by line.
"""

from __future__ import annotations

import ast
import re


def module_path(path: str) -> str:
    return re.sub("/__init__$", "", re.sub(r"\.[^./]+$", "", path)).replace("/", ".")


def import_candidates(path: str, module: str, level: int) -> list[str]:
    """Files that a module may be, best first; leading dots climb from the importing file's folder."""
    base: list[str] = []
    if level:
        folders = path.split("/")[:-1]
        if level - 1 > len(folders):
            return []
        base = folders[: len(folders) - (level - 1)]
    name = "/".join([*base, *(x for x in module.split(".") if x)])
    return [f"{name}.py", f"{name}/__init__.py"] if name else ["__init__.py"]


HEADER = re.compile(r"([ \t]*)(async[ \t]+def|def|class)[ \t]+(\w+)")


def tolerant_parse(source: bytes, tries: int = 200) -> ast.Module | None:
    """The tree of what parses, by the lines of ``source``; None if it can't be mended."""
    lines, mended = source.decode("utf-8", "replace").replace("\0", " ").split("\n"), set()
    for _ in range(tries):
        try:
            return ast.parse("\n".join(lines))
        except SyntaxError as e:
            body = re.search(r"expected an indented block after .* on line (\d+)", e.msg or "")
            n = int(body[1]) - 1 if body else min(max((e.lineno or 1) - 1, 0), len(lines) - 1)
            if body:
                lines[n], mark = lines[n] + " pass", (n, "body")
            elif (m := HEADER.match(lines[n])) and (n, "header") not in mended:
                lines[n], mark = f"{m[1]}{m[2]} {m[3]}{'' if m[2] == 'class' else '()'}:", (n, "header")
            else:
                indent = lines[n][: len(lines[n]) - len(lines[n].lstrip())]
                mark = (n, "gone" if (n, "line") in mended else "line")
                lines[n] = "" if mark[1] == "gone" else indent + "pass"
            if mark in mended:
                return None
            mended.add(mark)
        except (ValueError, RecursionError):
            return None
    return None


def python_facts(path: str, source: bytes) -> dict:
    module, base = module_path(path), path.rsplit("/", 1)[-1]
    out: dict = {"package": module, "symbols": [], "imports": [], "exports": [], "calls": [], "hints": [], "diagnostics": [], "fields": []}
    test_file = base.startswith("test_") or base.endswith("_test.py")
    text = source.decode("utf-8", "replace")
    starts = [0, *(m.end() for m in re.finditer(b"\n", source))]

    def add(name: str, receiver: str, kind: str, start: tuple[int, int], end: tuple[int, int]) -> int:
        stop = starts[end[0]] - 1 if end[0] < len(starts) else len(source)
        a, b = starts[start[0] - 1] + start[1], min(starts[end[0] - 1] + end[1], stop)
        out["symbols"].append({"name": name, "receiver": receiver, "canonical_name": ".".join(x for x in (module, receiver, name) if x), "kind": kind, "signature": source[a:b].decode("utf-8", "replace").strip(), "synthetic": False, "start_line": start[0], "start_col": start[1] + 1, "end_line": end[0], "end_col": end[1] + 1, "start_byte": a, "end_byte": b})
        return len(out["symbols"]) - 1

    def export(name: str) -> None:
        out["exports"].append({"name": name, "canonical_name": f"{module}.{name}", "is_default": False})

    tree = tolerant_parse(source)
    if tree is None:
        for n, line in enumerate(text.split("\n"), 1):
            if m := re.match(r"(?:async\s+)?(def|class)\s+(\w+)", line):
                width = len(line.encode())
                add(m[2], "", "class" if m[1] == "class" else "test_function" if test_file or m[2].startswith("test_") else "function", (n, 0), (n, width))
                export(m[2])
        return out

    def piece(node: ast.AST) -> str:
        return source[starts[node.lineno - 1] + node.col_offset : starts[node.end_lineno - 1] + node.end_col_offset].decode("utf-8", "replace").strip()

    def calls(symbol: int, receiver: str, body: list[ast.stmt]) -> None:
        found = [n for s in body for n in ast.walk(s) if isinstance(n, ast.Call)]
        for n in sorted(found, key=lambda c: (c.lineno, c.col_offset, -c.end_lineno, -c.end_col_offset)):
            fn = n.func
            if isinstance(fn, ast.Name):
                form, operand, name, owner = "identifier", "", fn.id, ""
            elif isinstance(fn, ast.Attribute):
                operand, name, owner = piece(fn.value), fn.attr, receiver
                form = "self" if operand in ("self", "cls") else "member"
            else:
                form, operand, name, owner = "dynamic", "", "", ""
            out["calls"].append({"symbol": symbol, "order_index": 0, "evidence": piece(fn), "form": form, "operand": operand, "name": name, "owner": owner})

    def visit(nodes: list[ast.stmt], owner: str) -> None:
        for n in nodes:
            if isinstance(n, ast.ClassDef):
                add(n.name, "", "class", (n.lineno, n.col_offset), (n.end_lineno, n.end_col_offset))
                export(n.name)
                visit(n.body, n.name)
            elif isinstance(n, ast.FunctionDef | ast.AsyncFunctionDef):
                kind = "test_function" if test_file or n.name.startswith("test_") else "method" if owner else "function"
                s = add(n.name, owner, kind, (n.lineno, n.col_offset), (n.end_lineno, n.end_col_offset))
                if not owner:
                    export(n.name)
                calls(s, owner, n.body)
            else:
                for name in ("body", "orelse", "finalbody"):
                    if isinstance(inner := getattr(n, name, None), list):
                        visit(inner, owner)
                for h in getattr(n, "handlers", []):
                    visit(h.body, owner)

    visit(tree.body, "")
    for n in ast.walk(tree):
        if isinstance(n, ast.Import):
            for a in n.names:
                out["imports"].append({"source": a.name, "alias": a.asname or a.name.split(".")[0], "imported_name": "", "export_name": "", "is_default": False, "is_namespace": True, "candidates": import_candidates(path, a.name, 0)})
        elif isinstance(n, ast.ImportFrom):
            for a in n.names:
                if a.name != "*":
                    out["imports"].append({"source": "." * n.level + (n.module or ""), "alias": a.asname or a.name, "imported_name": a.name, "export_name": a.name, "is_default": False, "is_namespace": False, "candidates": import_candidates(path, n.module or "", n.level)})
    return out
