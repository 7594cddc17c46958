"""A tolerant parser for Go: tokens with automatic semicolons, then recursive descent.

Text is handled as latin-1, so that offsets are byte offsets. Unknown constructs are skipped token by token;
no input makes the parser fail.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

TOKEN = re.compile(
    r"""(?P<space>[ \t\r]+)|(?P<newline>\n)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>"(?:\\.|[^"\\\n])*"?|`[^`]*(?:`|\Z)|'(?:\\.|[^'\\\n])*'?)"""
    r"""|(?P<number>0[xXbBoO][0-9a-fA-F_.]+|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?i?)|(?P<name>[A-Za-z_\x80-\xff][A-Za-z0-9_\x80-\xff]*)"""
    r"""|(?P<op>\.\.\.|&\^=|<<=|>>=|&\^|<<|>>|<-|\+\+|--|&&|\|\||:=|==|!=|<=|>=|[-+*/%&|^]=|.)""",
    re.S,
)
KEYWORDS = set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
ENDS_LINE = {"break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"}
PRECEDENCE = {"||": 1, "&&": 2, **dict.fromkeys(("==", "!=", "<", "<=", ">", ">="), 3), **dict.fromkeys("+-|^", 4), **dict.fromkeys(("*", "/", "%", "<<", ">>", "&", "&^"), 5)}


@dataclass
class Node:
    kind: str
    start: int
    end: int = 0
    children: list[Node] = field(default_factory=list)
    parts: dict[str, Node | list[Node] | str] = field(default_factory=dict)

    def walk(self) -> Iterator[Node]:
        """Pre-order, in order of position."""
        stack = [self]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(sorted(n.children, key=lambda c: -c.start))


def tokens(text: str) -> list[tuple[str, str, int, int]]:
    out: list[tuple[str, str, int, int]] = []

    def semicolon(at: int) -> None:
        if out and (out[-1][0] in ("name", "string", "number") or out[-1][1] in ENDS_LINE):
            out.append((";", ";", at, at))

    for m in TOKEN.finditer(text):
        kind, value = m.lastgroup, m.group()
        if kind == "newline" or kind == "comment" and "\n" in value:
            semicolon(m.start())
        elif kind not in ("space", "comment"):
            out.append(("keyword" if value in KEYWORDS else kind, value, m.start(), m.end()))
    semicolon(len(text))
    out.append(("eof", "", len(text), len(text)))
    return out


class Parser:
    def __init__(self, source: bytes):
        self.text = source.decode("latin-1")
        self.toks, self.i, self.control, self.depth = tokens(self.text), 0, False, 0

    # -- tokens
    @property
    def v(self) -> str:
        return self.toks[self.i][1]

    @property
    def k(self) -> str:
        return self.toks[self.i][0]

    @property
    def at(self) -> int:
        return self.toks[self.i][2]

    @property
    def last(self) -> int:
        return self.toks[self.i - 1][3] if self.i else 0

    def is_op(self, v: str) -> bool:
        return self.v == v and self.k not in ("string", "name")

    def take(self, v: str) -> bool:
        if self.is_op(v):
            self.i += 1
            return True
        return False

    def skip(self) -> None:
        if self.k != "eof":
            self.i += 1

    def done(self, n: Node) -> Node:
        n.end = max(self.last, n.start)
        return n

    def add(self, n: Node, name: str, child: Node | list[Node] | None) -> None:
        if child is None:
            return
        n.parts[name] = child
        n.children.extend(child if isinstance(child, list) else [child])

    # -- declarations
    def file(self) -> Node:
        root = Node("source_file", 0)
        while self.k != "eof":
            before = self.i
            if self.v in ("import", "type", "var", "const"):
                root.children.extend(self.group())
            elif self.v == "func":
                root.children.append(self.function())
            elif self.v == "package":
                n = Node("package_clause", self.at)
                self.skip()
                self.add(n, "name", self.identifier())
                root.children.append(self.done(n))
            if self.i == before:
                self.skip()
        return self.done(root)

    def group(self) -> list[Node]:
        word = self.v
        self.skip()
        one = {"import": self.import_spec, "type": self.type_spec, "var": self.value_spec, "const": self.value_spec}[word]
        if not self.take("("):
            return [one()]
        out = []
        while self.k != "eof" and not self.take(")"):
            before = self.i
            if not self.take(";"):
                out.append(one())
            if self.i == before:
                self.skip()
        return out

    def import_spec(self) -> Node:
        n = Node("import_spec", self.at)
        if self.k == "name" or self.is_op("."):
            n.parts["name"] = self.v
            self.skip()
        if self.k == "string":
            n.parts["path"] = self.v
            self.skip()
        return self.done(n)

    def type_spec(self) -> Node:
        n = Node("type_spec", self.at)
        self.add(n, "name", self.identifier())
        if self.is_op("[") and self.toks[self.i + 1][0] == "name" and self.toks[self.i + 2][1] != "]":
            self.balanced("[", "]")
        self.take("=")
        self.add(n, "type", self.type())
        return self.done(n)

    def value_spec(self) -> Node:
        n = Node("var_spec", self.at)
        names: list[Node] = []
        while self.k == "name":
            names.append(self.identifier())
            if not self.take(","):
                break
        self.add(n, "left", names)
        if not self.is_op("=") and not self.is_op(";") and not self.is_op(")"):
            self.add(n, "type", self.type())
        if self.take("="):
            self.add(n, "right", self.expressions())
        return self.done(n)

    def function(self) -> Node:
        n = Node("function_declaration", self.at)
        self.skip()
        if self.is_op("("):
            n.kind = "method_declaration"
            start = self.at
            n.parts["receiver"] = self.parameters()
            n.parts["receiver_text"] = self.text[start : self.last]
        self.add(n, "name", self.identifier())
        if self.is_op("["):
            self.balanced("[", "]")
        self.signature(n)
        if self.is_op("{"):
            self.add(n, "body", self.block())
        return self.done(n)

    def signature(self, n: Node) -> None:
        n.parts["parameters"] = self.parameters() if self.is_op("(") else []
        if self.is_op("("):
            self.parameters()
        elif self.k in ("name",) or self.v in ("*", "[", "map", "chan", "func", "struct", "interface", "<-") and self.k != "string":
            self.type()

    def parameters(self) -> list[Node]:
        """Parameter nodes with name (may be empty) and type; names that share a type are separate nodes."""
        self.take("(")
        entries: list[tuple[str | None, Node | None, int]] = []
        while self.k != "eof" and not self.is_op(")"):
            before, start = self.i, self.at
            self.take("...")
            kind = self.type()
            if self.k == "name" or self.v in ("*", "[", "map", "chan", "func", "struct", "interface", "...", "<-", "(") and not self.is_op(")"):
                self.take("...")
                entries.append((self.text[kind.start : kind.end], self.type(), start))
            else:
                entries.append((None, kind, start))
            self.take(",")
            self.take(";")
            if self.i == before:
                self.skip()
        self.take(")")
        named = any(name is not None for name, _, _ in entries)
        out: list[Node] = []
        follow: Node | None = None
        for name, kind, start in reversed(entries):
            if named and name is None:
                name, kind = self.text[kind.start : kind.end], follow
            follow = kind
            p = Node("parameter_declaration", start, kind.end if kind else start)
            p.parts["name"] = name or ""
            if kind:
                p.parts["type"] = kind
            out.append(p)
        return out[::-1]

    def balanced(self, a: str, b: str) -> None:
        depth = 0
        while self.k != "eof":
            depth += self.is_op(a) - self.is_op(b)
            self.skip()
            if depth == 0:
                return

    # -- types
    def type(self) -> Node:
        n = Node("type", self.at)
        if self.depth > 200:
            self.skip()
            return self.done(n)
        self.depth += 1
        try:
            if self.take("*"):
                n.kind = "pointer_type"
                self.add(n, "type", self.type())
            elif self.take("("):
                inner = self.type()
                self.take(")")
                n.kind = "parenthesized_type"
                self.add(n, "type", inner)
            elif self.is_op("["):
                self.balanced("[", "]")
                n.kind = "slice_type"
                self.add(n, "type", self.type())
            elif self.v == "map":
                self.skip()
                n.kind = "map_type"
                if self.take("["):
                    self.add(n, "key", self.type())
                    self.take("]")
                self.add(n, "value", self.type())
            elif self.v == "chan" or self.is_op("<-"):
                self.skip()
                if self.v == "chan":
                    self.skip()
                self.take("<-")
                n.kind = "channel_type"
                self.add(n, "type", self.type())
            elif self.v == "func":
                self.skip()
                n.kind = "function_type"
                self.signature(n)
            elif self.v == "struct":
                self.skip()
                n.kind = "struct_type"
                n.children.extend(self.fields())
            elif self.v == "interface":
                self.skip()
                n.kind = "interface_type"
                if self.is_op("{"):
                    self.balanced("{", "}")
            elif self.k == "name":
                n.kind = "type_identifier"
                first = self.v
                self.skip()
                if self.is_op(".") and self.toks[self.i + 1][0] == "name":
                    self.skip()
                    self.skip()
                    n.kind = "qualified_type"
                    n.parts["package"] = first
                if self.is_op("[") and not self.is_slice_of_name():
                    self.balanced("[", "]")
                    n = Node("generic_type", n.start, 0, [self.done(n)], {"type": n})
            else:
                self.skip()
        finally:
            self.depth -= 1
        return self.done(n)

    def is_slice_of_name(self) -> bool:
        """``name []T`` in a parameter list is a name with a slice type."""
        return self.toks[self.i + 1][1] == "]" or self.toks[self.i + 1][0] == "number"

    def fields(self) -> list[Node]:
        out: list[Node] = []
        if not self.take("{"):
            return out
        while self.k != "eof" and not self.take("}"):
            before = self.i
            if self.take(";"):
                continue
            n = Node("field_declaration", self.at)
            names: list[str] = []
            if self.k == "name" and (self.toks[self.i + 1][0] in ("name", "keyword") or self.toks[self.i + 1][1] in (",", "*", "[", "(", "<-")):
                while self.k == "name":
                    names.append(self.v)
                    self.skip()
                    if not self.take(","):
                        break
            n.parts["names"] = names  # type: ignore[assignment]
            self.add(n, "type", self.type())
            if self.k == "string":
                self.skip()
            out.append(self.done(n))
            if self.i == before:
                self.skip()
        return out

    # -- statements
    def block(self) -> Node:
        n = Node("block", self.at)
        self.take("{")
        held, self.control = self.control, False
        while self.k != "eof" and not self.is_op("}"):
            before = self.i
            s = self.statement()
            if s is not None:
                n.children.append(s)
            if self.i == before:
                self.skip()
        self.take("}")
        self.control = held
        return self.done(n)

    def statement(self) -> Node | None:
        start, word = self.at, self.v if self.k == "keyword" else ""
        if self.take(";"):
            return None
        if self.is_op("{"):
            return self.block()
        if word in ("var", "const", "type"):
            n = Node("var_declaration" if word != "type" else "type_declaration", start)
            n.children.extend(self.group())
            return self.done(n)
        if word in ("go", "defer"):
            n = Node(f"{word}_statement", start)
            self.skip()
            self.add(n, "call", self.expression())
            return self.done(n)
        if word == "return":
            n = Node("return_statement", start)
            self.skip()
            if not self.is_op(";") and not self.is_op("}"):
                self.add(n, "values", self.expressions())
            return self.done(n)
        if word == "if":
            return self.if_statement()
        if word == "for":
            return self.for_statement()
        if word in ("switch", "select"):
            return self.switch_statement(word)
        if word in ("break", "continue", "goto", "fallthrough"):
            n = Node(f"{word}_statement", start)
            self.skip()
            if self.k == "name":
                self.skip()
            return self.done(n)
        if word in ("case", "default"):
            self.skip()
            n = Node("case", start)
            if word == "case":
                simple = self.simple()
                if simple:
                    n.children.append(simple)
            self.take(":")
            return self.done(n)
        return self.simple()

    def simple(self) -> Node | None:
        start = self.at
        if self.v == "range":
            n = Node("range_clause", start)
            self.skip()
            self.add(n, "right", self.expressions())
            return self.done(n)
        left = self.expressions()
        if self.is_op(":=") or self.is_op("=") or (len(self.v) > 1 and self.v.endswith("=") and self.v not in ("==", "!=", "<=", ">=") and self.k == "op"):
            n = Node("short_var_declaration" if self.v == ":=" else "assignment_statement", start)
            self.skip()
            self.add(n, "left", left)
            if self.v == "range":
                n.kind = "range_clause"
                self.skip()
            self.add(n, "right", self.expressions())
            return self.done(n)
        if self.is_op(":") and len(left) == 1 and left[0].kind == "identifier" and not self.control:
            self.skip()
            n = Node("labeled_statement", start, 0, left)
            return self.done(n)
        if self.take("++") or self.take("--"):
            return self.done(Node("inc_statement", start, 0, left))
        if self.take("<-"):
            left.append(self.expression())
            return self.done(Node("send_statement", start, 0, left))
        if not left:
            return None
        n = Node("expression_statement", start)
        self.add(n, "expressions", left)
        return self.done(n)

    def header(self) -> list[Node]:
        """Simple statements of a control clause, up to its block."""
        held, self.control = self.control, True
        out: list[Node] = []
        while self.k != "eof" and not self.is_op("{"):
            before = self.i
            if not self.take(";"):
                s = self.simple()
                if s:
                    out.append(s)
            if self.i == before:
                self.skip()
        self.control = held
        return out

    def if_statement(self) -> Node:
        n = Node("if_statement", self.at)
        self.skip()
        head = self.header()
        n.children.extend(head)
        if head and head[-1].kind == "expression_statement":
            n.parts["condition"] = head[-1].children[0]
        if self.is_op("{"):
            self.add(n, "body", self.block())
        if self.v == "else":
            self.skip()
            self.add(n, "else", self.if_statement() if self.v == "if" else self.block())
        return self.done(n)

    def for_statement(self) -> Node:
        n = Node("for_statement", self.at)
        self.skip()
        n.children.extend(self.header())
        if self.is_op("{"):
            self.add(n, "body", self.block())
        return self.done(n)

    def switch_statement(self, word: str) -> Node:
        n = Node("select_statement" if word == "select" else "expression_switch_statement", self.at)
        self.skip()
        head = self.header()
        n.children.extend(head)
        if head:
            if ".(type)" in self.text[head[-1].start : head[-1].end].replace(" ", ""):
                n.kind = "type_switch_statement"
            last = head[-1]
            n.parts["value"] = last.children[0] if last.kind == "expression_statement" else last
            if n.kind == "type_switch_statement" and last.parts.get("right"):
                n.parts["value"] = last.parts["right"][0]
            if n.kind == "type_switch_statement" and n.parts["value"].kind == "type_assertion":
                n.parts["value"] = n.parts["value"].children[0]
        if self.is_op("{"):
            self.add(n, "body", self.block())
        return self.done(n)

    # -- expressions
    def expressions(self) -> list[Node]:
        out: list[Node] = []
        while self.k != "eof":
            before = self.i
            e = self.expression()
            if e is not None and self.i > before:
                out.append(e)
            if self.i == before or not self.take(","):
                break
        return out

    def expression(self, level: int = 0) -> Node:
        left = self.unary()
        while self.k == "op" and PRECEDENCE.get(self.v, 0) > level:
            rank = PRECEDENCE[self.v]
            self.skip()
            right = self.expression(rank)
            left = self.done(Node("binary_expression", left.start, 0, [left, right]))
        return left

    def unary(self) -> Node:
        start = self.at
        if self.k == "op" and self.v in ("&", "*", "-", "+", "!", "^", "<-"):
            n = Node("unary_expression", start)
            n.parts["operator"] = self.v
            self.skip()
            self.add(n, "operand", self.unary())
            return self.done(n)
        return self.primary()

    def identifier(self) -> Node | None:
        if self.k != "name":
            return None
        n = Node("identifier", self.at)
        self.skip()
        return self.done(n)

    def primary(self) -> Node:
        start = self.at
        if self.depth > 200:
            self.skip()
            return self.done(Node("error", start))
        self.depth += 1
        try:
            return self.suffixes(self.operand())
        finally:
            self.depth -= 1

    def operand(self) -> Node:
        start = self.at
        if self.k in ("string", "number"):
            n = Node("string_literal" if self.k == "string" and self.v[0] in '"`' else "literal", start)
            self.skip()
            return self.done(n)
        if self.k == "name":
            return self.identifier()
        if self.v == "func" and self.k == "keyword":
            n = Node("func_literal", start)
            self.skip()
            self.signature(n)
            if self.is_op("{"):
                held, self.control = self.control, False
                self.add(n, "body", self.block())
                self.control = held
            else:
                n.kind = "function_type"
            return self.done(n)
        if self.is_op("("):
            self.skip()
            held, self.control = self.control, False
            n = Node("parenthesized_expression", start)
            self.add(n, "inner", self.expression())
            while self.k != "eof" and not self.is_op(")"):
                self.skip()
            self.take(")")
            self.control = held
            return self.done(n)
        if self.is_op("[") or self.v in ("map", "chan", "struct", "interface") and self.k == "keyword":
            t = self.type()
            return self.literal(t) if self.is_op("{") else t
        if self.k == "keyword" or self.v in (")", "}", "]", ";", ",", ":", "{", "=", ":="):
            return self.done(Node("error", start))
        self.skip()
        return self.done(Node("error", start))

    def suffixes(self, n: Node) -> Node:
        while True:
            if self.is_op("."):
                self.skip()
                if self.take("("):
                    m = Node("type_assertion", n.start, 0, [n])
                    while self.k != "eof" and not self.is_op(")"):
                        self.skip()
                    self.take(")")
                else:
                    m = Node("selector_expression", n.start)
                    self.add(m, "operand", n)
                    self.add(m, "field", self.identifier())
                n = self.done(m)
            elif self.is_op("("):
                m = Node("call_expression", n.start)
                self.add(m, "function", n)
                self.add(m, "arguments", self.arguments())
                n = self.done(m)
            elif self.is_op("["):
                m = Node("index_expression", n.start, 0, [n])
                self.skip()
                held, self.control = self.control, False
                while self.k != "eof" and not self.take("]"):
                    before = self.i
                    m.children.append(self.expression())
                    self.take(":")
                    self.take(",")
                    if self.i == before:
                        self.skip()
                self.control = held
                n = self.done(m)
            elif self.is_op("{") and not self.control and n.kind in ("identifier", "selector_expression", "index_expression"):
                n = self.literal(n)
            else:
                return n

    def arguments(self) -> list[Node]:
        self.take("(")
        held, self.control = self.control, False
        out: list[Node] = []
        while self.k != "eof" and not self.take(")"):
            before = self.i
            e = self.expression()
            if self.i > before:
                out.append(e)
            self.take("...")
            self.take(",")
            self.take(";")
            if self.i == before:
                self.skip()
        self.control = held
        return out

    def literal(self, kind: Node) -> Node:
        n = Node("composite_literal", kind.start)
        self.add(n, "type", kind)
        n.parts["elements"] = self.elements()
        n.children.extend(x for pair in n.parts["elements"] for x in pair if x is not None)
        return self.done(n)

    def elements(self) -> list[tuple[Node | None, Node]]:
        self.take("{")
        held, self.control = self.control, False
        out: list[tuple[Node | None, Node]] = []
        while self.k != "eof" and not self.take("}"):
            before = self.i
            key, value = None, self.element()
            if self.take(":"):
                key, value = value, self.element()
            if self.i > before:
                out.append((key, value))
            self.take(",")
            self.take(";")
            if self.i == before:
                self.skip()
        self.control = held
        return out

    def element(self) -> Node:
        if self.is_op("{"):
            n = Node("literal_value", self.at)
            pairs = self.elements()
            n.parts["elements"] = pairs  # type: ignore[assignment]
            n.children.extend(x for pair in pairs for x in pair if x is not None)
            return self.done(n)
        return self.expression()


def parse(source: bytes) -> Node:
    return Parser(source).file()
