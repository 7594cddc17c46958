"""Main text of web pages by tree scoring.

A tolerant tokenizer builds the tree of block elements. Every paragraph earns points for its length and
commas, discounted by the share of its characters inside links, and passes them to its ancestors with
falling weight. The container with most points is the article, or the article or main element around it;
siblings that score high enough, or that hold few links, are kept with it. Elements that are never article text (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, comments), by tag or by a whole class or id, are left out
wherever they stand; but where a class or id would leave out most of a page's text, its node is scored like
the others (save comments and consent notices). Null, empty and textless html gives an empty text; pages are
read one by one and whole, so repeated rows come back as often and length is no limit. Of equal containers
the first wins. A column named like the result is replaced, other columns stay.
"""

from __future__ import annotations

import functools
import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factgraph.llm.common import released

TOKEN = re.compile(r"""<(?:!--.*?(?:-->|\Z)|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>)""", re.S)
ATTRIBUTE = re.compile(r"""(class|id|role|hidden|itemprop|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/]|$)""", re.I)
#: Contents are not markup.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
DROPPED_TAGS = {"head", "nav", "header", "footer", "aside", "form", "button", "select", "noscript", "template", "svg", "math", "canvas", "audio", "video", "object", "map", "menu", "dialog", "fieldset"}
#: Words of class and id names that mark what is not article text.
DROPPED_WORDS = set(
    """ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist
    consent cookie cookies disqus dropdown footer footnav gdpr header masthead menu menubar modal nav navbar navigation
    newsletter notice notices pager pagination popup popover promo promoted promotion recommend recommended related
    replies respond share sharing sidebar signup skip social sponsor sponsored subscribe tags toolbar widget widgets""".split()
)
#: Of these words, those whose nodes are never brought back.
FIRM_WORDS = {"comment", "comments", "commentlist", "disqus", "replies", "respond", "consent", "cookie", "cookies", "gdpr"}
#: Last words of names such as ad-slot, and first words of names that tell a state, such as has-sidebar.
PART_WORDS = set("area bar block bottom box button buttons container content entry form group holder icon icons inner item items left link links list main meta overlay panel region right row section slot text title top unit wrap wrapper zone".split())
STATE_WORDS = {"has", "with", "without", "no", "not", "is", "show", "hide", "js"}
KEPT_TAGS = {"html", "body", "article", "main"}
DROPPED_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alert", "form"}
PARAGRAPHS = {"p", "pre", "td", "blockquote", "li", "dd", "dt", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption"}
#: A start tag of the key closes an open element of the value.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"ul", "ol", "dl", "table", "article", "section", "div", "main", "body"}
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HREF = re.compile(r"(?:^|[\s\"'])href\s*=", re.I)


@functools.lru_cache(maxsize=1 << 14)
def named_unwanted(name: str) -> int:
    """Whether one class or id marks what is not article text: 0 no, 1 yes, 2 yes and firmly."""
    words = [w.lower() for w in WORD.findall(name)]
    if not words or words[0] in STATE_WORDS:
        return 0
    found = [w for w, counts in ((words[-1], True), (words[0], words[-1] in PART_WORDS)) if counts and w in DROPPED_WORDS]
    return 0 if not found else 2 if FIRM_WORDS.intersection(words) else 1


def unwanted(tag: str, attributes: str) -> int:
    """0 for wanted nodes, 1 for those unwanted by name alone, 2 for those unwanted for certain."""
    if tag in DROPPED_TAGS:
        return 2
    if not attributes or tag in KEPT_TAGS:
        return 0
    out = 0
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            out = max([out, *map(named_unwanted, value.split())])
        if name == "role" and value.lower() in DROPPED_ROLES:
            return 2
        if name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            return 2
    return out


@functools.lru_cache(maxsize=64)
def end_of(tag: str) -> re.Pattern:
    return re.compile(f"</{re.escape(tag)}", re.I | re.A)


class Page:
    """Nodes (tag, parent, dropped) and blocks (node, text, characters in links), in page order.

    ``dropped`` is 0 for wanted nodes, -1 for those that are out for certain, else the node whose name leaves them out.
    """

    def __init__(self, source: str):
        self.tags, self.parents, self.dropped = ["#root"], [-1], [0]
        self.blocks: list[tuple[int, str, int]] = []
        self.pieces: list[str] = []
        self.linked, self.link_depth, self.stack = 0, 0, [0]
        at = 0
        while True:
            m = TOKEN.search(source, at)
            end = m.start() if m else len(source)
            if end > at:
                self.text(source[at:end])
            if not m:
                break
            at = m.end()
            tag = (m[2] or m[5] or "").lower()
            if not tag:
                continue
            if m[1] or m[4]:
                self.close(tag)
            else:
                attributes = m[3] or m[6] or ""
                self.open(tag, attributes)
                if tag in RAW and not attributes.endswith("/"):
                    stop = end_of(tag).search(source, at)
                    at = stop.start() if stop else len(source)
        self.flush()

    def text(self, piece: str) -> None:
        if "&" in piece:
            piece = entities.unescape(piece)
        self.pieces.append(piece)
        if self.link_depth:
            self.linked += len(piece.strip())

    def flush(self) -> None:
        if self.pieces:
            if text := " ".join("".join(self.pieces).split()):
                self.blocks.append((self.stack[-1], text, min(self.linked, len(text))))
            self.pieces.clear()
        self.linked = 0

    def pop_to(self, depth: int) -> None:
        self.flush()
        del self.stack[depth:]
        if len(self.stack) < self.link_depth:  # the block in which the link began is over
            self.link_depth = 0

    def open(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self.pieces.append(" ")
            return
        if tag in VOID and tag != "hr":
            return
        if tag == "a":
            self.link_depth = len(self.stack) if HREF.search(attributes) else 0
            return
        if tag in RAW:
            self.pieces.append("")
        if tag in INLINE and not (attributes and unwanted(tag, attributes)):
            return
        if tag not in INLINE and tag not in RAW:
            self.flush()
            for depth in range(len(self.stack) - 1, 0, -1):
                name = self.tags[self.stack[depth]]
                if name == "p" or name in CLOSES.get(tag, ()):
                    self.pop_to(depth)
                    break
                if name in SCOPES:
                    break
        if tag == "hr":
            return
        self.flush()
        self.tags.append(tag)
        self.parents.append(self.stack[-1])
        above, here = self.dropped[self.stack[-1]], 2 if tag in RAW else unwanted(tag, attributes)
        self.dropped.append(-1 if above < 0 or here == 2 else len(self.tags) - 1 if here else above)
        self.stack.append(len(self.tags) - 1)

    def close(self, tag: str) -> None:
        if tag == "a":
            self.link_depth = 0
            return
        for depth in range(len(self.stack) - 1, 0, -1):
            if self.tags[self.stack[depth]] == tag:
                self.pop_to(depth)
                return
        if tag == "p":
            self.flush()


def main_text(source: str) -> str:
    """Blocks of the best container and its kept siblings, joined by an empty line."""
    page = Page(source)
    named: dict[int, list[int]] = {}
    for node, text, linked in page.blocks:
        if page.dropped[node] >= 0:
            tally = named.setdefault(page.dropped[node], [0, 0])
            tally[0], tally[1] = tally[0] + len(text), tally[1] + linked
    wanted, back = named.pop(0, [0, 0])[0], 0
    if named:
        node = max(named, key=lambda k: (named[k][0], -k))
        if named[node][0] > 4 * wanted and 2 * named[node][1] < named[node][0]:
            back = node
    page.dropped = [0 if d == back else d for d in page.dropped]
    shown = [b for b in page.blocks if not page.dropped[b[0]]]
    if not shown:
        return ""
    n = len(page.tags)
    points, chars, links = [0.0] * n, [0] * n, [0] * n
    for node, text, linked in shown:
        up = node
        while up >= 0:
            chars[up] += len(text)
            links[up] += linked
            up = page.parents[up]
        if len(text) < 25 and page.tags[node][0] != "h":
            continue
        earned = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))
        up, weight = page.parents[node] if page.tags[node] in PARAGRAPHS and node else node, 1.0
        while up >= 0 and weight > 0.1:
            points[up] += earned * weight
            up, weight = page.parents[up], weight / 2
    for i, tag in enumerate(page.tags):
        if chars[i]:
            points[i] = (points[i] + {"article": 25, "main": 10}.get(tag, 0)) * (1 - links[i] / chars[i])
    best = max((i for i in range(n) if chars[i] and not page.dropped[i]), key=lambda i: (points[i], -i), default=0)
    if points[best] <= 0:
        best = 0
    around = best
    while around >= 0 and page.tags[around] not in ("article", "main"):
        around = page.parents[around]
    best = around if around > 0 else best
    keep = {best}
    parent = page.parents[best]
    if parent >= 0:
        least = max(10.0, points[best] * 0.2)
        for i in range(n):
            if page.parents[i] == parent and i != best and chars[i]:
                density = links[i] / chars[i]
                if points[i] >= least and density < 0.5 or density < 0.25 or page.tags[i] == "h1":
                    keep.add(i)
    inside = [False] * n
    for i in range(n):
        inside[i] = i in keep or (i > 0 and inside[page.parents[i]])
    lists: dict[int, list[int]] = {}
    for node, text, linked in shown:
        if page.tags[node] == "li":
            tally = lists.setdefault(page.parents[node], [0, 0, 0])
            tally[0], tally[1], tally[2] = tally[0] + 1, tally[1] + len(text), tally[2] + linked
    menus = {k for k, (items, size, linked) in lists.items() if items >= 3 and linked > 0.8 * size}
    return "\n\n".join(text for node, text, _ in shown if inside[node] and not (page.tags[node] == "li" and page.parents[node] in menus))


def extract_main_text(df: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """The other columns of ``df`` and ``out``, the article's text; a column named ``out`` is replaced."""
    others = [c for c in df.columns if c not in (html, out)]
    plain = df.select(*[F.col(f"`{c}`") for c in others], F.col(html).alias("__html"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema.fields[:-1]), f"`{out}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = [main_text(x) if x else "" for x in part.column(part.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(texts, pa.string())], names=[*others, out])

    return plain.mapInArrow(released(run), schema)
