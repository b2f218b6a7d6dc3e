"""Extraction, sharding, packing, languages, licences and fingerprints against plain versions."""

from __future__ import annotations

import math
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import util
from webloom.llm import bestfit, html_density, imatch, license_scan, ppm_langid, sharding

MAKE = pytest.mark.parametrize("make", [util.clashing, util.empty])


# HTML.
PAGE = """<html><head><title> A &amp; B </title><script>if (a<b) "</p>"</script></head><body><nav><ul><li><a href=/x>one</a><li><a href=/y>two</a></ul></nav>
<div class=ad>Buy this thing now please.</div><div><article><h1>Heading of it</h1><p>{0}<p>{1} <a href=/z>and</a> more</article></div><footer>&copy; somebody, all of it</footer></body></html>"""


def test_content_of_a_page():
    one, two = util.prose(5, 40), util.prose(6, 50)
    title, text, best = html_density.extract(PAGE.format(one, two))
    assert title == "A & B" and best > 0
    assert text.split("\n") == ["Heading of it", one, f"{two} and more"]


def naive_density(html):
    """Density sums straight from the definition, by walking up from each node."""
    page = html_density.Page(html)
    n = len(page.tag)

    def inside(i, j):
        while i >= 0:
            if i == j:
                return True
            i = page.parent[i]
        return False

    def linked(i):
        while i >= 0:
            if page.tag[i] == "a":
                return True
            i = page.parent[i]
        return False

    size = lambda t: len("".join(t.split()))
    stats = []
    for j in range(n):
        own = [(i, t) for i, t in page.pieces if inside(i, j)]
        below = [i for i in range(n) if i != j and inside(i, j)]
        stats.append((sum(size(t) for _, t in own), len(below), sum(size(t) for i, t in own if linked(i)), sum(page.tag[i] == "a" for i in below)))
    share = stats[0][2] / max(1, stats[0][0])
    d = []
    for c, t, lc, lt in stats:
        if not c:
            d.append(0.0)
            continue
        b = math.log(c / max(1, c - lc) * lc + share * c + math.e)
        d.append(c / (t or 1) * math.log(c / (lc or 1) * (t or 1) / (lt or 1)) / (math.log(b) if b > 1 else 1))
    return d, [sum(d[i] for i in range(n) if page.parent[i] == j) for j in range(n)]


def test_densities_from_the_definition():
    html = PAGE.format("some words", "others <b>of <i>these</i></b>")
    page = html_density.Page(html)
    page.measure()
    d, s = naive_density(html)
    assert page.density == pytest.approx(d) and page.sums == pytest.approx(s)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div>", "</div>", "<a href='x'>", "</a>", "text", " ", "<", ">", "&amp;", "<br/>", "<script>", "</script>", "<!--", "-->", "<li>", "é"]), max_size=40))
def test_any_soup(parts):
    html_density.extract("".join(parts))


def test_pages_edges(spark):
    deep = "<div>" * 3000 + "x" + "</div>" * 3000
    rows = [(1, None), (2, ""), (3, "plain"), (3, "plain"), (None, "<p>a"), (4, deep), (5, PAGE.format(util.LONG, "b"))]
    df = spark.createDataFrame(rows, "page_id bigint, html string").selectExpr("*", "1 AS text", "2 AS title", "3 AS HTML")
    got = {r.page_id: r for r in html_density.extract_pages(df).collect()}
    assert html_density.extract_pages(df).count() == 7 and got[1].text is None and got[2].text == "" and got[3].text == "plain" and got[4].text == "x"
    assert len(got[5].text) > len(util.LONG)
    assert html_density.extract_pages(df.limit(0)).count() == 0


# Sharding.
def naive_place(vectors, capacities):
    left, out = [list(c) for c in capacities], []
    scale = [max(1, max(c[k] for c in capacities)) for k in range(3)]
    for v in vectors:
        dots = [sum(v[k] * x[k] / scale[k] ** 2 for k in range(3)) for x in left]
        fits = [all(x[k] >= v[k] - 1e-9 * scale[k] for k in range(3)) for x in left]
        among = [i for i in range(len(left)) if fits[i]] or list(range(len(left)))
        best = max(among, key=lambda i: (round(dots[i], 9), -i))
        for k in range(3):
            left[best][k] -= v[k]
        out.append(best)
    return out


def test_place_as_defined():
    r = np.random.default_rng(1)
    v = r.integers(1, 100, (60, 3)).astype(float)
    cap = np.tile(v.sum(0) / 4, (4, 1))
    assert sharding.place(v, cap).tolist() == naive_place(v.tolist(), cap.tolist())


def test_shards_balance(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = sharding.assign(df, 250_000, 1)
    t = out.groupBy("shard").sum("bytes", "tokens").toPandas()
    n = out.groupBy("shard").count().toPandas()["count"]
    assert out.count() == df.count() and len(t) == math.ceil(t["sum(bytes)"].sum() / 250_000)
    for column in (t["sum(bytes)"], t["sum(tokens)"], n):
        assert column.max() < 1.25 * column.mean()


def test_shards_by_brute_force(spark):
    """The registered query against plain loops over its groups."""
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    slotted, shards = sharding._slotted(df, sharding.SHARD_BYTES, sharding.LEAST_SHARDS)
    group, of = {}, {}
    for r in slotted.collect():
        g = group.setdefault((r.source, r.slot), [0, 0, 0])
        g[0], g[1], g[2] = g[0] + r.bytes, g[1] + r.tokens, g[2] + 1
        of.setdefault((r.source, r.slot), []).append(r.doc_id)
    whole = [sum(g[i] for g in group.values()) for i in range(3)]
    keys = sorted(group, key=lambda k: (-max(x / w for x, w in zip(group[k], whole)), k))
    where = naive_place([group[k] for k in keys], [[w / shards for w in whole]] * shards)
    want = {i: s for k, s in zip(keys, where) for i in of[k]}
    assert shards == 16 and {r.doc_id: r.shard for r in sharding.query(spark, "/root/testdata/sf0.001").collect()} == want


def test_shards_in_cells(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = sharding.assign(df, 100_000, 1, cell_shards=10)
    t = out.groupBy("shard").sum("bytes").toPandas()["sum(bytes)"]
    assert out.count() == df.count() and len(t) == 25 and t.max() < 1.4 * t.mean()


@MAKE
def test_shards_edges(spark, make):
    df = make(spark)
    out = sharding.assign(df, 1000)
    assert sorted((r.doc_id for r in out.collect()), key=repr) == sorted((r.doc_id for r in df.collect()), key=repr)


# Packing.
@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=60))
def test_best_fit_as_defined(sizes):
    room, want = [], []
    for s in sizes:
        fits = [r for r in room if r >= s]
        if fits:
            b = max(i for i, r in enumerate(room) if r == min(fits))
            want.append(room[b] - s)
            room[b] -= s
        else:
            room.append(20 - s)
            want.append(20 - s)
    got = bestfit.best_fit(np.array(sizes, int), 20)
    left = defaultdict(lambda: 20)
    rooms = []
    for s, b in zip(sizes, got.tolist()):
        left[b] -= s
        rooms.append(left[b])
    assert rooms == want


@MAKE
def test_packing_edges(spark, make):
    df = make(spark)
    bins = bestfit.pack_documents(df.repartition(40), 256).collect()
    got = Counter()
    for b in bins:
        assert 0 < b.n_tokens <= 256 and b.n_tokens == sum(m.n_tokens for m in b.members)
        for m in b.members:
            got[m.doc_id] += m.n_tokens
    want = Counter()
    for r in df.collect():
        want[r.doc_id] += len((r[1] or "").split())
    assert got == +want and len({b.bin_id for b in bins}) == len(bins)


def test_packing_is_tight_over_rounds(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(64)
    bins = bestfit.pack_documents(df, 2048).collect()
    assert len(bins) <= 1.03 * math.ceil(sum(b.n_tokens for b in bins) / 2048)


# Languages.
def brute_bits(texts, text):
    order = ppm_langid.ORDER
    counts = [defaultdict(Counter) for _ in range(order + 1)]
    for t in texts:
        b = bytes([ppm_langid.PAD]) * order + t
        for i in range(order, len(b)):
            for k in range(order + 1):
                counts[k][b[i - k : i]][b[i]] += 1
    b, bits = bytes([ppm_langid.PAD]) * order + text, 0.0
    for i in range(order, len(b)):
        for k in range(order, -1, -1):
            seen = counts[k].get(b[i - k : i])
            if seen:
                total = sum(seen.values()) + len(seen)
                if b[i] in seen:
                    bits -= math.log2(seen[b[i]] / total)
                    break
                bits -= math.log2(len(seen) / total)
        else:
            bits += 8
    return bits


def test_code_lengths_are_exact():
    texts = {"x": [b"the cat sat on the mat", b"a cat"], "y": ["où est le chat".encode(), b"le mat"], "z": [b""]}
    model = ppm_langid.train(texts)
    for t in ("the chat", "é\x00", "q", "le le le the the"):
        got = model.totals(pa.array([t]))[0]
        assert got == pytest.approx([brute_bits(texts[k], t.encode()) for k in "xyz"], rel=1e-5)


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    held = df.filter("doc_id % 5 = 0")
    score = ppm_langid.scorer(df.filter("doc_id % 5 > 0"))
    got = held.select("lang", score("text").alias("r")).selectExpr("lang", "r.lang AS guess", "r.accepted").toPandas()
    assert (got["lang"] == got["guess"]).mean() > 0.97 and got["accepted"].all()


@MAKE
def test_language_edges(spark, make):
    df = make(spark)
    out = ppm_langid.identify(df)
    assert out.count() == df.count()
    by = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    if by:
        assert by[5].lang is None and not by[5].accepted and by[7].lang is None and not by[12].accepted and by[1].accepted and by[1].lang == by[2].lang
    kept = ppm_langid.keep_accepted(df)
    assert kept.columns == df.columns and kept.count() == out.filter("accepted").count()


def test_no_labels(spark):
    df = util.edge(spark).selectExpr("doc_id", "text")
    assert {r.accepted for r in ppm_langid.identify(df).filter("doc_id IN (1, 9)").collect()} == {True}


# Licences.
@pytest.fixture(scope="module")
def model():
    return license_scan.train([util.prose(s, 25) for s in range(300)])


def test_templates_and_strangers(model):
    lines = [t for own in license_scan.TEMPLATES.values() for t in own]
    of = [f for f, own in license_scan.TEMPLATES.items() for _ in own]
    found = {i: family for i, family, *_ in model.finds(pa.array(lines))}
    assert np.mean([found.get(i) == f for i, f in enumerate(of)]) > 0.95
    odd = ["Licensed under the EUPL, version 1.2.", "Licensed under the Eclipse Public License."]
    assert {f for _, f, *_ in model.finds(pa.array(odd))} <= {"unknown"}
    assert not list(model.finds(pa.array([util.prose(s, 30) for s in range(900, 1000)])))


@pytest.mark.parametrize("family,line", [
    ("MIT", "of this software and associated documentation files (the \"Software\"), to deal"), ("MIT", "in the Software without restriction, including without limitation the rights"),
    ("MIT", "to use, copy, modify, merge, publish, distribute, sublicense, and/or sell"), ("GPL", "This program is free software: you can redistribute it and/or modify"),
    ("Apache-2.0", "distributed under the License is distributed on an \"AS IS\" BASIS,"), ("BSD", "notice, this list of conditions and the following disclaimer in the"),
    ("proprietary", "All rights reserved."), ("GPL", "This work is licensed under the GNU General Public License, version 3."), ("CC-BY-NC", "Licensed under CC BY-NC 4.0."),
])
def test_lines_of_licence_texts(model, family, line):
    assert [f for _, f, *_ in model.finds(pa.array([line]))] == [family]


@pytest.mark.parametrize("line", ["All rights reserved by the hotel to refuse entry.", "All seats reserved for the guests.", "She renewed the license of the shop.", "of the", "a copy of the letter"])
def test_lines_with_words_of_licences(model, line):
    assert {f for _, f, *_ in model.finds(pa.array([line]))} <= {"unknown"}


def test_scores_by_brute_force(model):
    from webloom.llm._text import U64, mix, words

    lines = ["Released under the MIT License.", "the license of the software", "", "nothing here"]
    np.seterr(over="ignore")
    where, logits = model.logits(pa.array(lines))
    weight = {int(h): model.weights[i] for i, h in enumerate(model.vocabulary)}
    for i, line in enumerate(lines):
        h, _ = words(pa.array([line]))
        feats = {int(x) for x in h} | {int(mix(np.array([a * U64(0x9E3779B97F4A7C15) + b], U64))[0]) for a, b in zip(h, h[1:])}
        np.seterr(over="warn")
        known = [weight[f] for f in feats if f in weight]
        assert bool(known) == (i in where.tolist())
        if known:
            assert logits[where.tolist().index(i)] == pytest.approx(np.sum(known, 0) + model.intercept, abs=1e-4)


@MAKE
def test_licence_edges(spark, make):
    extra = [(50, "x\nReleased under the MIT License.\ny\nReleased under the MIT License.", "en", "s", 1)]
    df = make(spark)
    assert license_scan.scan(df).count() == 0
    more = spark.createDataFrame(extra * 2, util.SCHEMA).unionByName(df, allowMissingColumns=True) if len(df.columns) == 5 else spark.createDataFrame(extra * 2, util.SCHEMA)
    assert [(r.doc_id, r.paragraph, r.family) for r in license_scan.scan(more).orderBy("paragraph").collect()] == [(50, 1, "MIT")] * 2 + [(50, 3, "MIT")] * 2


# Fingerprints.
@MAKE
def test_fingerprints_edges(spark, make):
    df = make(spark)
    out = imatch.fingerprints(df)
    assert out.count() == df.count()
    assert util.rows(out) == util.rows(imatch.fingerprints(df, max_broadcast=-1))
    by = {r.doc_id: r for r in out.collect() if r.doc_id is not None}
    if by:
        assert by[7].n_terms == 0 and by[7].fp_0 is None and by[1].fp_0 == by[2].fp_0


def test_every_label_is_a_language(spark):
    import random

    r = random.Random(3)
    rows = []
    for i in range(70):
        for _ in range(1 + (i < 64)):
            rows.append((len(rows), "".join(chr(0x4E00 + 40 * i + r.randrange(40)) for _ in range(300)), f"l{i:02}"))
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert {r.doc_id: r.lang for r in ppm_langid.identify(df).collect()} == {i: lang for i, _, lang in rows}
    assert ppm_langid.keep_accepted(df).count() == len(rows)


@pytest.mark.parametrize("page", ["<a " * 350_000, '<a href="' * 120_000, "<a \">\" " * 150_000, "<!" * 500_000, "<p><div>" + "<span>" * 60_000 + "<h1></h1>" * 60_000, "<a<b" * 250_000 + ">", "< " * 500_000, "<li><ul>" * 60_000])
def test_pages_take_time_in_proportion(page):
    from time import perf_counter

    began = perf_counter()
    html_density.extract(page)
    assert perf_counter() - began < 6


def brute_content(page):
    """Content nodes by recursion over the definition in the module's docstring."""
    n = len(page.tag)
    kids = [[j for j in range(1, n) if page.parent[j] == i] for i in range(n)]

    def under(i):
        return [i] + [x for k in kids[i] for x in under(k)]

    sums = [sum(page.density[k] for k in kids[i]) for i in range(n)]
    if max(sums[1:], default=0) <= 0:
        return set(range(n))
    sums[0] = 0.0
    at = top = max(range(n), key=lambda i: (sums[i], -i))
    path = [at]
    while at:
        at = page.parent[at]
        path.append(at)
    threshold = min(page.density[i] for i in path)
    chosen = set()

    def down(i):
        if page.density[i] < threshold - 1e-9:
            return
        best = max(under(i), key=lambda x: (sums[x], -x))
        if sums[best] > 0:
            chosen.update(under(best))
        for k in kids[i]:
            down(k)

    down(0)
    assert top in chosen
    return chosen


def test_content_equals_brute_force(spark):
    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        page = html_density.Page(r.html)
        page.measure()
        sums = list(page.sums)
        got, best = page.content()
        assert got == brute_content(page) and best == max(sums[1:], default=0)


def test_large_groups_are_packed_in_slices(spark):
    """A group that is dealt into slices gives as good bins as a whole one, up to the root."""
    df = spark.range(0, 4000, 1, 40).selectExpr("id AS doc_id", "20 + pmod(xxhash64(id), 60) AS n")
    bins = bestfit.pack_documents(df, 100, "n", max_group=300).collect()
    assert sorted(m.doc_id for b in bins for m in b.members) == list(range(4000)) and all(sum(m.n_tokens for m in b.members) == b.n_tokens <= 100 for b in bins)
    assert len({b.bin_id for b in bins}) == len(bins) <= 1.02 * bestfit.pack_documents(df, 100, "n").count()
