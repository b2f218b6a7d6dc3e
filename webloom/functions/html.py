"""HTML functions: the regular-expression forms are Columns, the full forms run over Arrow batches."""

from __future__ import annotations

import codecs
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import squash
from .url import normalize_url

MAX_LINKS = 2000
MIN_TEXT = 100
MAX_READABLE = 512 * 1024
_CHARSET = re.compile(rb"""<meta[^>]+charset=["']?\s*([A-Za-z0-9_.:-]+)""", re.I)


def title(html: Column) -> Column:
    return squash(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def links(html: Column) -> Column:
    """Distinct href values of anchors, in order, without those marked nofollow, MAX_LINKS at most."""
    tags = F.filter(F.regexp_extract_all(html, F.lit(r"(?i)<a\s[^>]*>"), F.lit(0)), lambda t: ~F.regexp_like(t, F.lit(r"(?i)rel\s*=\s*.?[^>]*nofollow")))
    hrefs = F.transform(tags, lambda t: F.regexp_extract(t, r"""(?i)href\s*=\s*["']([^"']*)["']""", 1))
    return F.slice(F.array_distinct(F.filter(hrefs, lambda h: h != "")), 1, MAX_LINKS)


def meta_robots(html: Column, word: str) -> Column:
    """Whether a robots meta tag's content has the word."""
    tags = F.regexp_extract_all(html, F.lit(r"(?i)<meta\s[^>]*name\s*=\s*.?robots[^>]*>"), F.lit(0))
    return F.exists(tags, lambda t: F.contains(F.lower(t), F.lit(word)))


def fallback_text(html: Column) -> Column:
    """Body text without scripts, styles and noscript, tags to spaces, white space squashed."""
    body = F.regexp_replace(html, r"(?is)<!--.*?-->", " ")
    for t in ("head", "script", "style", "noscript"):
        body = F.regexp_replace(body, rf"(?is)<{t}[ >].*?</{t}>", " ")
    return squash(F.regexp_replace(body, r"(?s)<[^>]*>", " "))


def decode_html(raw: bytes, content_type: str | None = None) -> str:
    """By the header's charset, else the byte order mark, else a meta tag in the first 2048 bytes, else UTF-8."""
    name = None
    if content_type and "charset=" in content_type:
        name = content_type.split("charset=", 1)[1].split(";")[0].strip().strip("\"'")
    for mark, of in ((codecs.BOM_UTF8, "utf-8-sig"), (codecs.BOM_UTF16_LE, "utf-16"), (codecs.BOM_UTF16_BE, "utf-16")):
        if name is None and raw.startswith(mark):
            name = of
    if name is None and (m := _CHARSET.search(raw[:2048])):
        name = m[1].decode("ascii")
    try:
        return raw.decode(name or "utf-8", "replace")
    except LookupError:
        return raw.decode("utf-8", "replace")


class _Reader(HTMLParser):
    SKIP = frozenset(("script", "style", "noscript", "template"))
    BLOCK = frozenset("p div article section main li td th pre blockquote h1 h2 h3 h4 h5 h6 ul ol table tr nav header footer aside body form".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.title, self.in_title, self.skip, self.in_link = "", False, 0, 0
        self.hrefs: list[str] = []
        self.robots = ""
        self.blocks: list[list] = [[[], 0, 0, False]]  # pieces, characters, link characters, boilerplate
        self.boiler = 0

    def handle_starttag(self, tag, attrs):
        a = {k: v or "" for k, v in attrs}
        if tag == "title":
            self.in_title = True
        elif tag in self.SKIP:
            self.skip += 1
        elif tag == "meta" and a.get("name", "").lower() == "robots":
            self.robots += " " + a.get("content", "").lower()
        elif tag == "a":
            self.in_link += 1
            if a.get("href") and "nofollow" not in a.get("rel", "").lower():
                self.hrefs.append(a["href"])
        if tag in ("nav", "header", "footer", "aside", "form"):
            self.boiler += 1
        if tag in self.BLOCK:
            self.blocks.append([[], 0, 0, self.boiler > 0])

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        elif tag in self.SKIP:
            self.skip = max(0, self.skip - 1)
        elif tag == "a":
            self.in_link = max(0, self.in_link - 1)
        if tag in ("nav", "header", "footer", "aside", "form"):
            self.boiler = max(0, self.boiler - 1)
        if tag in self.BLOCK:
            self.blocks.append([[], 0, 0, self.boiler > 0])

    def handle_data(self, data):
        if self.in_title:
            self.title += data
        elif not self.skip:
            b = self.blocks[-1]
            b[0].append(data)
            n = len(data.strip())
            b[1] += n
            b[2] += n * (self.in_link > 0)


def read_page(html: str, base: str) -> tuple[str, str | None, list[str], bool]:
    """(title, main text or None, links, noindex). Blocks dense in links and those of page furniture aren't main text;
    if that leaves under MIN_TEXT characters, or the page is over MAX_READABLE, all visible text is taken; still under
    MIN_TEXT is None."""
    r = _Reader()
    r.feed(html)
    r.close()
    everything = " ".join("".join(" ".join(b[0]) for b in r.blocks if b[1]).split())
    text = everything
    if len(html) <= MAX_READABLE:
        main = " ".join(" ".join(" ".join(b[0]).split()) for b in r.blocks if b[1] and not b[3] and b[2] * 2 <= b[1])
        text = main if len(main) >= MIN_TEXT or len(main) > len(everything) else everything
    name = " ".join(r.title.split()) or text[:80]
    found: dict[str, None] = {}
    if "nofollow" not in r.robots:
        for h in r.hrefs:
            if len(found) < MAX_LINKS and (u := normalize_url(h, base)):
                found[u] = None
    return name, text if len(text) >= MIN_TEXT else None, list(found), "noindex" in r.robots


PAGE = "struct<title:string,text:string,links:array<string>,noindex:boolean>"


def extract(html: Column, url: Column) -> Column:
    @F.arrow_udf(PAGE)
    def run(pages: pa.Array, urls: pa.Array) -> pa.Array:
        rows = [None if h is None else dict(zip(("title", "text", "links", "noindex"), read_page(h, u or ""))) for h, u in zip(pages.to_pylist(), urls.to_pylist())]
        return pa.array(rows, pa.struct([("title", pa.string()), ("text", pa.string()), ("links", pa.list_(pa.string())), ("noindex", pa.bool_())]))

    return run(html, url)
