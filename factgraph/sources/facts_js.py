"""Raw facts of one JavaScript or TypeScript file, from a tolerant token stream with matched brackets."""

from __future__ import annotations

import posixpath
import re
from bisect import bisect_right

TOKEN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:\\.|[^"\\\n])*"?|'(?:\\.|[^'\\\n])*'?|`(?:\\.|[^`\\])*(?:`|\Z))"""
    r"""|(?P<number>\d[\w.]*)|(?P<name>[A-Za-z_$\x80-\xff][\w$\x80-\xff]*)|(?P<op>=>|\.\.\.|\?\.|[-+*/%&|^<>=!?]=+|&&|\|\||\?\?|.)""",
    re.S,
)
REGEX = re.compile(r"/(?![*/])(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\n\[])+/[a-z]*")
#: Suffixes tried for a relative import, in order.
SUFFIXES = [".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs"]
#: A piece of a template literal, up to its end or to a substitution.
TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^\\`$])*", re.S)
NOT_CALLED = {"if", "for", "while", "switch", "catch", "function", "return", "typeof", "await", "super", "import", "with", "new", "constructor"}


def module_path(path: str) -> str:
    return re.sub("/index$", "", re.sub(r"\.[^./]+$", "", path)).replace("/", ".")


def import_candidates(path: str, spec: str) -> list[str]:
    if not spec.startswith("."):
        return []
    base = posixpath.normpath(posixpath.join(posixpath.dirname(path), spec))
    return [base + s for s in SUFFIXES] + [f"{base}/index{s}" for s in SUFFIXES]


class Stream:
    def __init__(self, source: bytes):
        self.text = source.decode("latin-1")
        self.toks: list[tuple[str, str, int, int]] = []
        at, depth = 0, 0
        templates: list[int] = []  # brace depths at which a template literal goes on
        while at < len(self.text):
            before = self.toks[-1] if self.toks else None
            if self.text[at] == "`" or templates and templates[-1] == depth and self.text[at] == "}":
                if self.text[at] == "}":
                    self.toks.append(("op", "}", at, at + 1))
                    templates.pop()
                end = TEMPLATE.match(self.text, at + 1).end()
                more = self.text.startswith("${", end)
                self.toks.append(("string", self.text[at : end + (not more)], at, min(len(self.text), end + (not more))))
                if more:
                    self.toks.append(("op", "{", end, end + 2))
                    templates.append(depth)
                at = min(len(self.text), end + 1 + more)
                continue
            if self.text[at] == "/" and (before is None or before[0] == "op" and before[1] not in (")", "]", "}") or before[1] in ("return", "typeof", "case")):
                m = REGEX.match(self.text, at)
                if m:
                    self.toks.append(("string", m.group(), at, m.end()))
                    at = m.end()
                    continue
            m = TOKEN.match(self.text, at)
            at = m.end()
            depth += (m.group() == "{") - (m.group() == "}")
            if m.lastgroup not in ("space", "comment"):
                self.toks.append((m.lastgroup, m.group(), m.start(), m.end()))
        self.match: dict[int, int] = {}
        stack: list[int] = []
        for i, t in enumerate(self.toks):
            if t[0] == "op" and t[1] in "([{":
                stack.append(i)
            elif t[0] == "op" and t[1] in ")]}" and stack:
                j = stack.pop()
                self.match[j], self.match[i] = i, j

    def v(self, i: int) -> str:
        return self.toks[i][1] if 0 <= i < len(self.toks) else ""

    def close(self, i: int) -> int:
        return self.match.get(i, len(self.toks) - 1)


def js_facts(path: str, source: bytes) -> dict:
    s, module = Stream(source), module_path(path)
    out: dict = {"package": module, "symbols": [], "imports": [], "exports": [], "calls": [], "hints": [], "diagnostics": [], "fields": []}
    lines = [0, *(m.end() for m in re.finditer(b"\n", source))]
    test_file = ".test." in path or ".spec." in path

    def text(a: int, b: int) -> str:
        return source[a:b].decode("utf-8", "replace").strip()

    def add(name: str, receiver: str, kind: str, first: int, last: int) -> int:
        a, b = s.toks[first][2], s.toks[min(last, len(s.toks) - 1)][3]
        row, end = bisect_right(lines, a), bisect_right(lines, b)
        out["symbols"].append({"name": name, "receiver": receiver, "canonical_name": ".".join(x for x in (module, receiver, name) if x), "kind": kind, "signature": text(a, b), "synthetic": False, "start_line": row, "start_col": a - lines[row - 1] + 1, "end_line": end, "end_col": b - lines[end - 1] + 1, "start_byte": a, "end_byte": b})
        return len(out["symbols"]) - 1

    def kind_of(name: str) -> str:
        return "test_function" if test_file or name.lower().startswith("test") else "function"

    def calls(symbol: int, receiver: str, first: int, last: int) -> None:
        found = []
        for i in range(first, min(last + 1, len(s.toks))):
            if s.v(i) != "(" or s.toks[i][0] != "op" or i == 0:
                continue
            j = i - 1
            kind, value = s.toks[j][0], s.toks[j][1]
            if kind == "name" and (value in NOT_CALLED or s.v(j - 1) in ("function", "new")):
                continue
            if kind == "name" and s.v(s.close(i) + 1) == "{" and s.v(j - 1) not in (".", "?."):
                continue  # a method definition
            if kind != "name" and value not in (")", "]"):
                continue
            while True:  # back over the member chain
                if s.toks[j][0] == "op" and s.toks[j][1] in ")]" and j in s.match:
                    j = s.match[j] - 1
                    if j >= 0 and (s.toks[j][0] == "name" and s.v(j) not in NOT_CALLED or s.v(j) in (")", "]")):
                        continue
                    j += 1
                    break
                if s.v(j - 1) in (".", "?."):
                    j -= 2
                    continue
                break
            evidence = text(s.toks[j][2], s.toks[i - 1][3])
            if j == i - 1 and kind == "name":
                form, operand, name = "identifier", "", value
            elif kind == "name" and s.v(i - 2) in (".", "?."):
                operand, name = text(s.toks[j][2], s.toks[i - 3][3]), value
                form = "self" if operand == "this" and receiver else "member"
            else:
                form, operand, name = "dynamic", "", ""
            found.append((s.toks[j][2], -s.toks[s.close(i)][3], {"symbol": symbol, "order_index": 0, "evidence": evidence, "form": form, "operand": operand, "name": name, "owner": receiver}))
        out["calls"].extend(x for _, _, x in sorted(found, key=lambda f: f[:2]))

    def function_end(i: int) -> tuple[int, int]:
        """Body of a function whose parameters start at or after token i: first and last token."""
        while i < len(s.toks) and s.v(i) != "(":
            i += 1
        i = s.close(i) + 1
        while i < len(s.toks) and s.v(i) not in ("{", ";"):
            i += 1
        return i, s.close(i) if s.v(i) == "{" else i

    def arrow(i: int) -> tuple[int, int] | None:
        """Body of an arrow or function expression that starts at token i."""
        if s.v(i) == "async":
            i += 1
        if s.v(i) == "function":
            return function_end(i)
        j = s.close(i) + 1 if s.v(i) == "(" else i + 1
        while s.v(j) not in ("=>", "", ",", ";", ")", "{"):
            j += 1
        if s.v(j) != "=>":
            return None
        j += 1
        if s.v(j) == "{":
            return j, s.close(j)
        depth_end = j
        while depth_end < len(s.toks) and s.v(depth_end) not in (";", ",", ")", "}", "]"):
            if s.v(depth_end) in ("(", "[", "{"):
                depth_end = s.close(depth_end)
            elif depth_end > j and s.text[s.toks[depth_end - 1][3] : s.toks[depth_end][2]].count("\n") and s.toks[depth_end][0] != "op" and (s.toks[depth_end - 1][0] != "op" or s.v(depth_end - 1) in (")", "]", "}")):
                break  # a line that can't go on ends the statement
            depth_end += 1
        return j, depth_end - 1

    def class_body(name: str, i: int, end: int) -> None:
        i += 1
        while i < end:
            j = i
            while s.v(j) in ("static", "async", "get", "set", "*", "public", "private", "protected", "readonly", "override", "abstract") and s.v(j + 1) not in ("(", "="):
                j += 1
            if s.toks[j][0] in ("name", "string") and s.v(j + 1) == "(":
                a, b = function_end(j + 1)
                if s.v(a) == "{" and b <= end:
                    label = s.v(j).strip("\"'")
                    calls(add(label, name, kind_of(label), i, b), name, a, b)
                    i = b + 1
                    continue
            i = s.close(i) + 1 if s.v(i) in ("(", "[", "{") else i + 1

    def visit(i: int, end: int) -> None:
        while i < end:
            v, kind = s.v(i), s.toks[i][0]
            if kind == "name" and v == "class" and s.toks[i + 1][0] == "name" if i + 1 < end else False:
                j = i + 1
                while j < end and s.v(j) != "{":
                    j += 1
                add(s.v(i + 1), "", "class", i, s.close(j))
                class_body(s.v(i + 1), j, s.close(j))
                i = s.close(j) + 1
                continue
            if kind == "name" and v == "function":
                j = i + 2 if s.v(i + 1) == "*" else i + 1
                if s.toks[j][0] == "name" if j < end else False:
                    a, b = function_end(j)
                    calls(add(s.v(j), "", kind_of(s.v(j)), i, b), "", a, b)
                    i = b + 1
                    continue
            if kind == "name" and v in ("const", "let") and i + 2 < end and s.toks[i + 1][0] == "name":
                j = i + 2
                while j < end and s.v(j) not in ("=", ";", ","):
                    j += 1
                body = arrow(j + 1) if s.v(j) == "=" and j + 1 < end else None
                if body:
                    calls(add(s.v(i + 1), "", kind_of(s.v(i + 1)), i + 1, body[1]), "", *body)
                    visit(body[0] + 1, body[1])
                    i = body[1] + 1
                    continue
            if kind == "name" and v in ("test", "it") and s.v(i + 1) == "(" and s.v(i - 1) != ".":
                close = s.close(i + 1)
                j, label = i + 2, s.v(i + 2).strip("\"'`") if s.toks[i + 2][0] == "string" else v
                while j < close and s.v(j) != ",":
                    j += 1
                body = arrow(j + 1) if j < close else None
                if body:
                    row = bisect_right(lines, s.toks[i][2])
                    clean = re.sub("^_+|_+$", "", re.sub("[^A-Za-z0-9]", "_", label))
                    calls(add(f"__test_{clean}_{row}", "", "test_function", j + 1, body[1]), "", *body)
                    i = close + 1
                    continue
            i += 1

    visit(0, len(s.toks))

    def bind(source_: str, alias: str, imported: str, exported: str, default: bool, space: bool) -> None:
        out["imports"].append({"source": source_, "alias": alias, "imported_name": imported, "export_name": exported, "is_default": default, "is_namespace": space, "candidates": import_candidates(path, source_)})

    flat = re.compile(r"""^[ \t]*import\s+(?:type\s+)?(?:([^'"`;]*?)\s+from\s+)?(["'])([^"']+)\2""", re.M)
    for m in flat.finditer(s.text):
        clause, spec = m[1], m[3]
        if clause is None:
            bind(spec, posixpath.basename(spec), "default", "default", True, False)
            continue
        if braces := re.search(r"\{(.*?)\}", clause, re.S):
            for item in filter(None, (x.strip() for x in braces[1].split(","))):
                name, _, alias = item.removeprefix("type ").partition(" as ")
                bind(spec, (alias or name).strip(), name.strip(), name.strip(), False, False)
            clause = clause.replace(braces[0], "")
        for item in filter(None, (x.strip() for x in clause.split(","))):
            if star := re.match(r"\*\s+as\s+(\S+)", item):
                bind(spec, star[1], "", "", False, True)
            else:
                bind(spec, item, "default", "default", True, False)
    local = {x["name"]: x["canonical_name"] for x in out["symbols"] if not x["receiver"]}
    for m in re.finditer(r"^[ \t]*export\s+(default\s+)?(?:(?:async\s+)?(?:function\s*\*?|class|const|let|var)\s+([\w$]+)|\{([^}]*)\}|([\w$]+)\s*;?\s*$)", s.text, re.M):
        if m[3] is not None:
            for item in filter(None, (x.strip() for x in m[3].split(","))):
                name, _, alias = item.partition(" as ")
                label = (alias or name).strip()
                out["exports"].append({"name": label, "canonical_name": local.get(name.strip(), f"{module}.{name.strip()}"), "is_default": label == "default"})
        elif m[2] or m[1]:
            name = m[2] or m[4]
            out["exports"].append({"name": "default" if m[1] else name, "canonical_name": local.get(name, f"{module}.{name}"), "is_default": bool(m[1])})
    return out
