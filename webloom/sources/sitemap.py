"""Sitemaps: XML bytes, gzip or not, to page and child locations."""

from __future__ import annotations

import gzip
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LOCATIONS = 50_000
RESULT = "struct<pages:array<string>,children:array<string>>"


def parse_sitemap(raw: bytes) -> tuple[list[str], list[str]]:
    """(pages, children); namespaces don't matter, and a broken file gives what came before the break."""
    if raw[:2] == b"\x1f\x8b":
        try:
            raw = gzip.decompress(raw)
        except (OSError, EOFError):
            return [], []
    pages: list[str] = []
    children: list[str] = []
    stack: list[str] = []
    text: list[str] = []

    def start(name: str, _: dict) -> None:
        stack.append(name.rpartition(":")[2].lower())
        if stack[-1] == "loc":
            text.clear()

    def end(_: str) -> None:
        if stack and stack[-1] == "loc" and len(stack) > 1 and len(pages) + len(children) < MAX_LOCATIONS:
            found = "".join(text).strip()
            if found and stack[-2] == "url":
                pages.append(found)
            elif found and stack[-2] == "sitemap":
                children.append(found)
        if stack:
            stack.pop()

    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text.append
    try:
        parser.Parse(raw, True)
    except expat.ExpatError:
        pass
    return pages, children


def locations(raw: Column) -> Column:
    @F.arrow_udf(RESULT)
    def run(files: pa.Array) -> pa.Array:
        rows = [None if x is None else dict(zip(("pages", "children"), parse_sitemap(x))) for x in files.to_pylist()]
        return pa.array(rows, pa.struct([("pages", pa.list_(pa.string())), ("children", pa.list_(pa.string()))]))

    return run(raw)
