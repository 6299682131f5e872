"""The node table of HTML pages: one row for each element and text.

Trees are built page by page inside tasks, since what a tag closes depends on all that is open; everything that relates nodes to each
other afterwards is Spark's work. Each row carries its ancestors (nearest first), so ancestor conditions need no join.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of HTML: elements without an end tag, with raw or escapable text, those that end an open paragraph.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW, ESCAPABLE = frozenset("script style xmp iframe noembed noframes".split()), frozenset("title textarea".split())
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split())
#: What an element's start tag ends among the open ones, up to the nearest of the elements that follow.
ENDS = {
    **dict.fromkeys(["li"], ({"li"}, {"ul", "ol", "menu"})),
    **dict.fromkeys(["dt", "dd"], ({"dt", "dd"}, {"dl"})),
    **dict.fromkeys(["rb", "rt", "rtc", "rp"], ({"rb", "rt", "rp"}, {"ruby", "rtc"})),
    **dict.fromkeys(["option"], ({"option"}, {"select", "optgroup", "datalist"})),
    **dict.fromkeys(["optgroup"], ({"option", "optgroup"}, {"select"})),
    **dict.fromkeys(["td", "th"], ({"td", "th"}, {"tr", "table"})),
    **dict.fromkeys(["tr"], ({"tr"}, {"table", "tbody", "thead", "tfoot"})),
    **dict.fromkeys(["tbody", "thead", "tfoot"], ({"tbody", "thead", "tfoot", "colgroup", "caption"}, {"table"})),
    "body": ({"head"}, {"html"}),
}
ENDS["rtc"] = ({"rb", "rt", "rtc", "rp"}, {"ruby"})
LIMITS = frozenset("html body table td th caption button template svg math object marquee applet".split())
HEADINGS = frozenset(f"h{k}" for k in range(1, 7))
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
#: Pages of so many characters of html, or so many pages, are laid out in one batch of rows: small pages share one, large ones don't add up.
CHARACTERS, PAGES = 1 << 18, 1 << 10
ANCESTOR = pa.struct([("pre", pa.int32()), ("tag", pa.string()), ("ns", pa.string()), ("role", pa.string()), ("names", pa.string()), ("target", pa.string()), ("hidden", pa.bool_())])
SCHEMA = "page_id long, node_id int, parent_id int, pre int, post int, depth int, sib int, kind string, tag string, ns string, attrs map<string,string>, text string, anc array<struct<pre:int,tag:string,ns:string,role:string,names:string,target:string,hidden:boolean>>"
NAMES = "node_id parent_id pre post depth sib kind tag ns attrs text".split()


class Tree:
    """Nodes of one page in document order as lists; `post` is the number of the last descendant."""

    def __init__(self, html: str):
        self.parent: list[int] = []
        self.post: list[int] = []
        self.sib: list[int] = []
        self.tag: list[str | None] = []
        self.ns: list[str | None] = []
        self.attrs: list[dict[str, str] | None] = []
        self.text: list[str | None] = []
        self.path: list[list[int]] = []
        self.open: list[int] = []
        self.children: dict[int, int] = {}
        at, low = 0, html.lower()
        while at < len(html):
            m = TOKEN.search(html, at)
            self._text(html[at : m.start()] if m else html[at:])
            if not m:
                break
            at = m.end()
            if not m[2]:
                continue
            name = m[2].lower()
            if m[1]:
                self._end(name)
                continue
            self._start(name, m[3])
            if (name in RAW or name in ESCAPABLE) and self.open and self.tag[self.open[-1]] == name:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])").search(low, at)
                stop = close.start() if close else len(html)
                self._text(html[at:stop], name in ESCAPABLE)
                at = stop
        self._close(0)

    def _add(self, tag: str | None, ns: str | None, attrs: dict | None, text: str | None) -> int:
        n, parent = len(self.parent), self.open[-1] if self.open else -1
        sib = self.children[parent] = self.children.get(parent, 0) + 1
        self.parent.append(parent)
        self.post.append(n)
        self.sib.append(sib)
        self.tag.append(tag)
        self.ns.append(ns)
        self.attrs.append(attrs)
        self.text.append(text)
        self.path.append(self.open[::-1])
        return n

    def _close(self, to: int) -> None:
        for n in self.open[to:]:
            self.post[n] = len(self.parent) - 1
        del self.open[to:]

    def _close_nearest(self, names: set[str] | frozenset[str], stop: set[str] | frozenset[str]) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            tag = self.tag[self.open[k]]
            if tag in names:
                return self._close(k)
            if tag in stop:
                return

    def _text(self, data: str, decode: bool = True) -> None:
        if data:
            self._add(None, None, None, unescape(data) if decode and "&" in data else data)

    def _start(self, name: str, rest: str) -> None:
        ns = "html"
        if name in ("svg", "math"):
            ns = name
        elif self.open and self.ns[self.open[-1]] in ("svg", "math") and self.tag[self.open[-1]] not in ("foreignobject", "desc", "title", "annotation-xml"):
            ns = self.ns[self.open[-1]]
        if ns == "html":
            if name in ENDS:
                self._close_nearest(*ENDS[name])
            if name in ENDS_P:
                self._close_nearest({"p"}, LIMITS)
            if name in HEADINGS and self.open and self.tag[self.open[-1]] in HEADINGS:
                self._close(len(self.open) - 1)
        attrs: dict[str, str] = {}
        for m in ATTRIBUTE.finditer(rest):
            name_, *quoted = m.groups("")
            value = "".join(quoted)
            attrs.setdefault(name_.lower(), unescape(value) if "&" in value else value)
        n = self._add(name, ns, attrs, None)
        if name not in VOID and not (ns != "html" and rest.rstrip().endswith("/")):
            self.open.append(n)

    def _end(self, name: str) -> None:
        for k in range(len(self.open) - 1, -1, -1):
            if self.tag[self.open[k]] == name:
                return self._close(k)


def html_nodes(pages: DataFrame) -> DataFrame:
    """The nodes of each page's html; a null or empty html has none. Pages are dealt out anew first, since parsing costs far more than the move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, htmls = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, to in slices(htmls):
                yield _rows(ids[at:to], htmls[at:to])

    tasks = pages.sparkSession.sparkContext.defaultParallelism * 2
    return pages.select("page_id", "html").repartition(tasks).mapInArrow(run, SCHEMA)


def slices(htmls: list[str | None]) -> Iterator[tuple[int, int]]:
    """Begin and end of the pages that are laid out together."""
    at = size = 0
    for k, html in enumerate(htmls):
        size += len(html or "")
        if size >= CHARACTERS or k + 1 - at == PAGES:
            yield at, k + 1
            at, size = k + 1, 0
    if at < len(htmls):
        yield at, len(htmls)


def _rows(ids: list, htmls: list[str | None]) -> pa.RecordBatch:
    trees = [Tree(html or "") for html in htmls]
    sizes = np.array([len(tree.parent) for tree in trees], np.int64)
    every = lambda column: [x for tree in trees for x in getattr(tree, column)]
    tag, ns, attrs, path = every("tag"), every("ns"), every("attrs"), every("path")
    first = np.cumsum(sizes) - sizes
    number = pa.array(np.arange(sizes.sum()) - np.repeat(first, sizes), pa.int32())
    depth = np.fromiter(map(len, path), np.int64, len(path))
    # Ancestors are told by their numbers on the page; among all rows they lie as far on as their page does.
    places = np.fromiter(chain.from_iterable(path), np.int64, depth.sum()) + np.repeat(np.repeat(first, sizes), depth)
    own = [a or {} for a in attrs]
    lines = pa.StructArray.from_arrays([number, pa.array(tag, pa.string()), pa.array(ns, pa.string()), pa.array([a.get("role") for a in own], pa.string()), pa.array([f" {' '.join(a)} " for a in own], pa.string()), pa.array([a.get("for") for a in own], pa.string()), pa.array(["hidden" in a or a.get("aria-hidden") == "true" for a in own], pa.bool_())], fields=list(ANCESTOR))
    pairs = pa.MapArray.from_arrays(pa.array([0, *np.cumsum([len(a) for a in own])], pa.int32()), pa.array([k for a in own for k in a], pa.string()), pa.array([v for a in own for v in a.values()], pa.string()), mask=pa.array([a is None for a in attrs], pa.bool_()))
    values = {"node_id": number, "parent_id": pa.array(every("parent"), pa.int32()), "pre": number, "post": pa.array(every("post"), pa.int32()), "depth": pa.array(depth, pa.int32()), "sib": pa.array(every("sib"), pa.int32()), "kind": pa.array(["text" if t is None else "element" for t in tag], pa.string()), "tag": lines.field(1), "ns": lines.field(2), "attrs": pairs, "text": pa.array(every("text"), pa.string())}
    above = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(depth)]), pa.int32()), lines.take(pa.array(places)))
    page = pa.array(ids, pa.int64()).take(pa.array(np.repeat(np.arange(len(ids)), sizes)))
    return pa.RecordBatch.from_arrays([page, *(values[n] for n in NAMES), above], ["page_id", *NAMES, "anc"])
