"""Main text of HTML pages by composite text density.

The page is read into a tree in one pass over its tags. For every node with C characters (white space aside), T tags,
LC characters and LT tags of links in its subtree, and body's C_b and LC_b, the composite text density is

    C / T * log(C / LC * T / LT) / log(log(C / (C - LC) * LC + LC_b / C_b * C + e))

with 1 for a denominator of 0. A node's density sum is that of its children's densities. The node below body with the
largest sum is found, and the least density on the path from body to it is the threshold. From body down, through nodes
that reach the threshold, the subtree with the largest sum within each such node is content, if that sum is over 0:
a lone block beside the content, such as a notice or a footer, has no sum. Where no node has one, body is content. The
text is that of all content nodes in document order, a line for each block.

Nulls: a null page has null title and text; a page without tags or body counts as one body. Text of scripts, styles,
templates and comments is none. Pages of any depth and size are read whole, without recursion, in time proportional to
their length: after a tag with a quote that is never closed, tags end with the next ">", and what follows the last ">" is
text. Of equal density sums the first node wins. Rows with equal pages get equal results. Other columns, whatever their
names, are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from math import e, log

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from webloom.tables import table

from ._cols import pick

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>", re.S)
_TAG = re.compile(r"""<(/?)([A-Za-z][^\s/>]*+)((?:[^>"']|"[^"]*+"|'[^']*+')*+)>""")
_LOOSE_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)([^>]*+)>")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style noscript template textarea title iframe xmp".split())
_BLOCK = frozenset("address article aside blockquote body details dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tbody td tfoot th thead tr ul".split())
_SCOPE = frozenset("html body div article section main td th table ul ol dl aside nav header footer blockquote form".split())
#: an opening tag ends these open ones
_ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)} | {t: ("p",) for t in _BLOCK - {"li", "dt", "dd", "tr", "td", "th", "body"}}


class Page:
    """The tree of a page: parallel lists by node, parents before children."""

    def __init__(self, html: str):
        self.tag, self.parent = ["body"], [-1]
        self.pieces: list[tuple[int, str]] = []  # (node, text), in document order
        self.title = ""
        stack, at, begin = [0], 0, 0
        depths: dict[str, list[int]] = {}  # of the open nodes of each name, in the stack
        scopes = [0]
        low = None
        tag_of, last = _TAG, html.rfind(">")

        def close(name: str, scoped: bool) -> None:
            open_ = depths.get(name)
            if not open_ or (scoped and open_[-1] < scopes[-1]):
                return
            to = open_[-1]
            for gone in stack[to:]:
                depths[self.tag[gone]].pop()
            del stack[to:]
            while scopes[-1] >= to:
                scopes.pop()

        while (begin := html.find("<", begin)) >= 0:
            if begin > last and not html.startswith("<!--", begin):  # no tag ends any more
                begin = html.find("<!--", begin)
                if begin < 0:
                    break
            m = _COMMENT.match(html, begin)
            if not m:
                m = tag_of.match(html, begin)
                if not m and tag_of is _TAG and html[begin + 1 : begin + 3].lstrip("/")[:1].isalpha():
                    # a quote that is never closed: from here on a tag ends with the next ">", so that each is read once
                    tag_of = _LOOSE_TAG
                    m = tag_of.match(html, begin)
                if not m:
                    begin += 1
                    continue
            if begin > at:
                self.pieces.append((stack[-1], html[at:begin]))
            at = begin = m.end()
            name = (m[2] or "").lower() if m.re is not _COMMENT else ""
            if not name:
                continue
            if m[1]:
                close(name, False)
                continue
            if name in _RAW:
                low = low if low is not None else html.lower() if html.isascii() else _ascii_lower(html)
                end = low.find("</" + name, at)
                if name == "title" and not self.title:
                    self.title = " ".join(unescape(html[at : end if end >= 0 else len(html)]).split())
                at = len(html) if end < 0 else end
                if end >= 0:
                    stop = html.find(">", end)
                    at = len(html) if stop < 0 else stop + 1
                begin = at
                continue
            if name in ("html", "head", "body"):
                continue
            for gone in _ENDS.get(name, ()):
                close(gone, True)
            self.tag.append(name)
            self.parent.append(stack[-1])
            if name not in _VOID and not m[3].endswith("/"):
                depths.setdefault(name, []).append(len(stack))
                if name in _SCOPE:
                    scopes.append(len(stack))
                stack.append(len(self.tag) - 1)
        if at < len(html):
            self.pieces.append((stack[-1], html[at:]))
        self.pieces = [(n, unescape(t) if "&" in t else t) for n, t in self.pieces]

    def measure(self) -> None:
        n = len(self.tag)
        self.chars, self.tags, self.link_chars, self.link_tags = ([0] * n for _ in range(4))
        inside = [False] * n
        for i in range(n):
            inside[i] = self.tag[i] == "a" or (i > 0 and inside[self.parent[i]])
        for i, t in self.pieces:
            size = len("".join(t.split()))
            self.chars[i] += size
            if inside[i]:
                self.link_chars[i] += size
        for i in range(n - 1, 0, -1):
            p = self.parent[i]
            self.chars[p] += self.chars[i]
            self.tags[p] += self.tags[i] + 1
            self.link_chars[p] += self.link_chars[i]
            self.link_tags[p] += self.link_tags[i] + (self.tag[i] == "a")
        share = self.link_chars[0] / max(1, self.chars[0])
        self.density = [density(*x, share) for x in zip(self.chars, self.tags, self.link_chars, self.link_tags)]
        self.sums = [0.0] * n
        for i in range(1, n):
            self.sums[self.parent[i]] += self.density[i]

    def content(self) -> tuple[set[int], float]:
        """(content nodes with their subtrees, the largest density sum)."""
        n = len(self.tag)
        if max(self.sums[1:], default=0) <= 0:
            return set(range(n)), self.sums[0]
        self.sums[0] = 0.0
        best = list(range(n))  # node of the largest sum in each subtree, the first of equals
        for i in range(n - 1, 0, -1):
            p, b = self.parent[i], best[i]
            if self.sums[b] > self.sums[best[p]] or (self.sums[b] == self.sums[best[p]] and best[p] != p and b < best[p]):
                best[p] = b
        at = top = best[0]
        threshold = self.density[at]
        while at:
            at = self.parent[at]
            threshold = min(threshold, self.density[at])
        passes, chosen = [False] * n, set()
        for i in range(n):
            passes[i] = (i == 0 or passes[self.parent[i]]) and self.density[i] >= threshold - 1e-9
            if passes[i] and self.sums[best[i]] > 0:
                chosen.add(best[i])
        for i in range(1, n):
            if self.parent[i] in chosen:
                chosen.add(i)
        return chosen, self.sums[top]

    def text(self, nodes: set[int]) -> str:
        out: list[str] = []
        block = [i if t in _BLOCK or i == 0 else -1 for i, t in enumerate(self.tag)]
        for i in range(1, len(block)):
            if block[i] < 0:
                block[i] = block[self.parent[i]]
        last = None
        for i, t in self.pieces:
            if i in nodes:
                if block[i] != last:
                    out.append("\n")
                    last = block[i]
                out.append(t)
        return "\n".join(x for x in (" ".join(line.split()) for line in _lines(out)) if x)


def _lines(parts: list[str]) -> Iterator[str]:
    held: list[str] = []
    for p in parts:
        if p == "\n":
            yield "".join(held)
            held = []
        else:
            held.append(p)
    yield "".join(held)


def _ascii_lower(s: str) -> str:
    return s.translate({c: c + 32 for c in range(65, 91)})


def density(chars: int, tags: int, link_chars: int, link_tags: int, body_share: float) -> float:
    if not chars:
        return 0.0
    t = tags or 1
    ratio = chars / (link_chars or 1) * t / (link_tags or 1)
    base = log(chars / ((chars - link_chars) or 1) * link_chars + body_share * chars + e)
    return chars / t * log(ratio) / (log(base) if base > 1 else 1.0)


def extract(html: str) -> tuple[str, str, float]:
    """(title, main text, density sum of the best node)."""
    page = Page(html)
    page.measure()
    nodes, best = page.content()
    return page.title, page.text(nodes), best


RESULT = "page_id bigint, title string, text string, n_chars bigint, density_sum double"


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            part = batch.slice(at, 512)
            rows = [(None, None, None) if h is None else extract(h) for h in part.column("html").to_pylist()]
            title, text, best = zip(*rows)
            yield pa.RecordBatch.from_arrays(
                [part.column("page_id"), pa.array(title, pa.string()), pa.array(text, pa.string()), pa.array([None if t is None else len(t) for t in text], pa.int64()), pa.array(best, pa.float64())],
                ["page_id", "title", "text", "n_chars", "density_sum"],
            )


def extract_pages(pages: DataFrame) -> DataFrame:
    """(page_id, title, text, n_chars, density_sum) of every page."""
    return pick(pages, page_id="bigint", html="string").mapInArrow(_run, RESULT)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))
