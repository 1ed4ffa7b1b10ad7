"""HTML text to a flat node table, one array per page.

This is the only place where HTML syntax is handled, and all it does is turn tags
into intervals. A node covers the nodes `i < j < last` and the texts
`t0 <= t < t1`, so every later question ("text of", "inside", "sibling of") is a
comparison of integers that Spark expressions answer.
"""

from __future__ import annotations

import html as entities
import json
import re

import pyarrow as pa
from pyspark.sql import Column

from sitelore import fixed
from sitelore.functions.slices import by_slices

# kids: child elements; place: position among the parent's kids; stop3, stop4: place of the
# next live heading up to h3, h4 after a heading; up: ancestors of an image, outermost first;
# solid: characters under the node that are not white space; alive: kept by noise removal
NODE = (
    "struct<i:int,parent:int,last:int,t0:int,t1:int,tag:string,"
    "attrs:map<string,string>,json:string,kids:array<int>,place:int,stop3:int,stop4:int,"
    "up:array<int>,solid:int,alive:boolean>"
)
DOM = f"nodes array<{NODE}>, texts array<string>, live array<boolean>"

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|"
    r"<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^>\"'])*+)>",
    re.S,
)
_ATTR = re.compile(r"([^\s=>\"'/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?")

# Element classes of the HTML repair rules.
VOID = frozenset(
    "area base basefont br col embed frame hr img input isindex link meta param source track wbr".split()
)
HEAD_ONLY = frozenset("base link meta script style title".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FONT_STYLE = frozenset("tt i b u s strike big small".split())
BLOCKS = (
    "address blockquote center dir div dl fieldset form hr menu ol pre table ul".split()
)
# a start tag ends the open element while that element is in its set
ENDS_OPEN = {
    **{tag: {"p"} for tag in BLOCKS},
    **{tag: {"p"} | HEADINGS for tag in HEADINGS},
    "p": {"p"} | HEADINGS | FONT_STYLE,
    "li": {"p", "li"} | HEADINGS,
    "dt": {"p", "dt", "dd"},
    "dd": {"p", "dt", "dd"},
    "option": {"option"},
    "a": {"a"},
    "tr": {"p", "th", "td", "tr", "caption", "col", "colgroup"},
    "td": {"p", "th", "td", "span", "font", "a", "b", "i", "u"},
    "th": {"p", "th", "td", "span", "font", "a", "b", "i", "u"},
    **{
        tag: {"p", "th", "td", "tr", "caption", "col", "colgroup", "thead", "tbody", "tfoot"}
        for tag in ("thead", "tbody", "tfoot")
    },
}
# an end tag does not reach past an open element of higher rank
END_RANK = {
    "div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180,
    "table": 190, "head": 200, "body": 200, "html": 220,
}


class _Builder:
    """Open-element stack that writes nodes in document order."""

    def __init__(self) -> None:
        self.nodes: list[dict] = []
        self.texts: list[str] = []
        self.open: list[dict] = []
        self.body_seen = False

    def push(self, tag: str, attrs: dict | None = None) -> dict:
        node = {
            "i": len(self.nodes), "parent": self.open[-1]["i"] if self.open else -1, "last": 0,
            "t0": len(self.texts), "t1": 0, "tag": tag, "attrs": attrs or {}, "json": None,
        }
        self.nodes.append(node)
        self.open.append(node)
        return node

    def pop(self) -> None:
        node = self.open.pop()
        node["last"], node["t1"] = len(self.nodes), len(self.texts)

    def is_open(self, *tags: str) -> bool:
        return any(n["tag"] in tags for n in self.open)

    def enter(self, for_head: bool) -> None:
        """Open html and head or body where the page left them out."""
        if not self.open:
            self.push("html")
        if for_head and not self.body_seen:
            if not self.is_open("head", "body"):
                self.push("head")
            return
        if not self.is_open("body"):
            while self.open[-1]["tag"] != "html":
                self.pop()
            self.push("body")
            self.body_seen = True

    def start(self, tag: str, attrs: dict) -> dict | None:
        if tag in ("html", "body"):
            if tag == "html" and not self.open:
                return self.push("html", attrs)
            if tag == "body" and not self.is_open("body"):
                self.enter(for_head=False)
                self.open[-1]["attrs"] = attrs
            return None
        if tag == "head":
            if not self.is_open("head", "body"):
                if not self.open:
                    self.push("html")
                return self.push("head", attrs)
            return None
        self.enter(for_head=tag in HEAD_ONLY)
        ends = ENDS_OPEN.get(tag, ())
        while self.open[-1]["tag"] in ends:
            self.pop()
        node = self.push(tag, attrs)
        if tag in VOID:
            self.pop()
        return node

    def end(self, tag: str) -> None:
        if tag in ("html", "body"):
            return
        rank = END_RANK.get(tag, 100)
        for depth in range(len(self.open) - 1, -1, -1):
            name = self.open[depth]["tag"]
            if name == tag:
                while len(self.open) > depth:
                    self.pop()
                return
            if END_RANK.get(name, 100) > rank:
                return

    def text(self, raw: str) -> None:
        value = entities.unescape(raw)
        if not self.is_open("body", "title", "noscript"):
            if not value.strip():
                return
            self.enter(for_head=False)
            self.push("p")
        self.texts.append(value)


def _noisy(node: dict) -> bool:
    names = f"{node['attrs'].get('class', '')} {node['attrs'].get('id', '')}".lower()
    return node["tag"] in fixed.NOISE_TAGS or any(p in names for p in fixed.NOISE_PATTERNS)


def _relations(nodes: list[dict], texts: list[str]) -> list[bool]:
    """Add what relates nodes to each other, in one pass; returns which texts are live.

    Dead are scripts and similar, anything whose class or id contains a noise word, and
    then elements left without text, images or tables.
    """
    live, until = [True] * len(texts), 0
    for n in nodes:
        n["alive"] = n["i"] >= until
        if n["alive"] and _noisy(n):
            n["alive"], until = False, n["last"]
            live[n["t0"] : n["t1"]] = [False] * (n["t1"] - n["t0"])
        n.update(kids=[], place=0, stop3=None, stop4=None, up=None)
        if n["parent"] >= 0:
            siblings = nodes[n["parent"]]["kids"]
            n["place"] = len(siblings)
            siblings.append(n["i"])
    solid, full, media = [0], [0], [0]
    for t, kept in zip(texts, live):
        size = sum(map(len, t.split()))
        solid.append(solid[-1] + size)
        full.append(full[-1] + (kept and size > 0))
    for n in nodes:
        media.append(media[-1] + (n["alive"] and n["tag"] in ("img", "table")))
    for n in nodes:
        n["solid"] = solid[n["t1"]] - solid[n["t0"]]
        n["alive"] = n["alive"] and (
            n["tag"] in fixed.KEEP_WHEN_EMPTY_TAGS
            or full[n["t1"]] > full[n["t0"]]
            or media[n["last"]] > media[n["i"] + 1]
        )
        if n["tag"] == "img":
            n["up"], above = [], n["parent"]
            while above >= 0:
                n["up"].insert(0, above)
                above = nodes[above]["parent"]
    for n in nodes:
        stop3 = stop4 = len(n["kids"])
        for k in reversed(n["kids"]):
            kid = nodes[k]
            if kid["tag"] in ("h1", "h2", "h3", "h4"):
                kid["stop3"], kid["stop4"] = stop3, stop4
                if kid["alive"]:
                    stop4 = kid["place"]
                    stop3 = stop3 if kid["tag"] == "h4" else stop4
    return live


def _attributes(raw: str) -> dict:
    found: dict = {}
    for name, value in _ATTR.findall(raw):
        if value[:1] in ("\"", "'"):
            value = value[1:-1]
        found.setdefault(name.lower(), entities.unescape(value))
    return found


def parse_html(source: str | None) -> dict:
    """Nodes and texts of one page; comments, scripts and styles yield no text."""
    b = _Builder()
    source = source or ""
    at = pending = 0
    while True:
        m = _TOKEN.search(source, at)
        stop = m.start() if m else len(source)
        # a comment or declaration also separates two texts
        if stop > pending:
            b.text(source[pending:stop])
        if not m:
            break
        at = pending = m.end()
        if not m["tag"]:
            continue
        tag = m["tag"].lower()
        if m["end"]:
            b.end(tag)
            continue
        attrs = _attributes(m["attrs"]) if m["attrs"] else {}
        node = b.start(tag, attrs)
        if tag in ("script", "style", "template"):
            close = re.compile(rf"</{tag}\b[^>]*>", re.I).search(source, at)
            inner = source[at : close.start() if close else len(source)]
            at = pending = close.end() if close else len(source)
            if tag == "script" and "ld+json" in attrs.get("type", "").lower():
                try:
                    node["json"] = json.dumps(json.loads(inner), ensure_ascii=False, sort_keys=True)
                except ValueError:
                    pass
            b.end(tag)
    while b.open:
        b.pop()
    return {"nodes": b.nodes, "texts": b.texts, "live": _relations(b.nodes, b.texts)}


_ARROW_NODE = pa.struct(
    [
        *((name, pa.int32()) for name in ("i", "parent", "last", "t0", "t1")), ("tag", pa.string()),
        ("attrs", pa.map_(pa.string(), pa.string())), ("json", pa.string()), ("kids", pa.list_(pa.int32())),
        *((name, pa.int32()) for name in ("place", "stop3", "stop4")), ("up", pa.list_(pa.int32())),
        ("solid", pa.int32()), ("alive", pa.bool_()),
    ]
)
_ARROW_DOM = pa.struct(
    [("nodes", pa.list_(_ARROW_NODE)), ("texts", pa.list_(pa.string())), ("live", pa.list_(pa.bool_()))]
)


def _parse_pages(pages: list) -> pa.Array:
    parsed = [parse_html(p) for p in pages]
    for page in parsed:
        for node in page["nodes"]:
            node["attrs"] = list(node["attrs"].items())
    return pa.array(parsed, _ARROW_DOM)


def dom(html: Column) -> Column:
    """Node table of a page.

    Marked non-deterministic so that the optimizer keeps it in one place: it would
    otherwise copy the call into every filter it derives from the extracted columns.
    """
    return by_slices(_parse_pages, DOM).asNondeterministic()(html)
