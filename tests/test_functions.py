"""Scalar functions, sources and parsers by tables of cases."""

from __future__ import annotations

import gzip

import pytest
from pyspark.sql import functions as F

from webloom.functions import html, text, url
from webloom.operators import retrieval as R
from webloom.sources import config, csvs, robots, sitemap, warc

URLS = [
    ("http://Example.COM", "http://example.com/"), ("https://example.com:443/a", "https://example.com/a"), ("http://example.com:8080/", "http://example.com:8080/"), ("http://user:pw@example.com/x#y", "http://example.com/x"),
    ("https://e.org/a/./b/../c", "https://e.org/a/c"), ("https://e.org/?utm_source=x&a=1&fbclid=2", "https://e.org/?a=1"), ("https://e.org/?gclid=2", "https://e.org/"), ("ftp://e.org/", None), ("mailto:a@b", None), ("no url", None),
    ("https://e.org./p", "https://e.org/p"), ("https://bücher.example/", "https://xn--bcher-kva.example/"), ("https://e.org/a b", "https://e.org/a%20b"), ("https://e.org/" + "a" * 3000, None), ("http://e.org:99999/", None), ("HTTP://E.ORG/%7Ea", "http://e.org/%7Ea"),
]


@pytest.mark.parametrize("raw,want", URLS)
def test_normalize(raw, want):
    assert url.normalize_url(raw) == want


@pytest.mark.parametrize("rel,want", [("../x", "http://e.org/a/x"), ("/y", "http://e.org/y"), ("?q", "http://e.org/a/b/c?q"), ("//o.org", "http://o.org/"), ("javascript:1", None), ("#f", "http://e.org/a/b/c")])
def test_relative(rel, want):
    assert url.normalize_url(rel, "http://e.org/a/b/c") == want


def test_stems():
    pairs = {"running": "run", "hopping": "hop", "hoped": "hope", "flies": "fli", "relational": "relat", "conditional": "condit", "happiness": "happi", "generously": "generous", "cats": "cat", "agreed": "agre", "is": "is"}
    assert {w: text.stem(w) for w in pairs} == pairs


def test_language_guess():
    assert text.guess_language("the cat sat on the mat and it was of the house".split()) == "en"
    assert text.guess_language("der hund und die katze sind nicht mit dem auto".split()) == "de"
    assert text.guess_language(["zzz"]) is None


def test_snippet_window(spark):
    body = "x " * 200 + "alpha beta <tag> " + "y " * 200
    got = spark.createDataFrame([(body,), ("short & sweet",), (None,)], "t string").select(text.snippet(F.col("t"), ["alpha", "beta"]).alias("s")).collect()
    assert "<b>alpha</b> <b>beta</b> &lt;tag&gt;" in got[0].s and got[1].s == "short &amp; sweet" and got[2].s is None


def test_pages():
    page = "<title>T</title><meta name=ROBOTS content='noindex'><body><a href='/x?utm_a=1'>l</a><a rel=nofollow href='/n'>n</a><a href='/x'>again</a><script>secret</script>" + "<p>" + "word " * 40 + "</body>"
    title, body, links, noindex = html.read_page(page, "http://e.org/a")
    assert title == "T" and "secret" not in body and links == ["http://e.org/x"] and noindex
    assert html.read_page("<p>tiny", "http://e.org/")[1] is None
    assert html.read_page("<meta name=robots content=nofollow><a href=/x>x</a>", "http://e.org/")[2] == []
    assert len(html.read_page("<p>" + "a b " * 200_000, "http://e.org/")[1]) > 512 * 1024


def test_charsets():
    assert html.decode_html("é".encode("latin-1"), "text/html; charset=iso-8859-1") == "é"
    assert html.decode_html(b"<meta charset='windows-1252'>\xe9").endswith("é")
    assert html.decode_html(b"\xef\xbb\xbfa") == "a" and html.decode_html(b"\xff", "text/html; charset=nope") == "�"


def test_robots():
    body = "User-agent: other\nDisallow: /\n\nUser-agent: webloom/1.0\nUser-agent: x\nDisallow: /private\nAllow: /private/open\nDisallow: /*.pdf$\nCrawl-delay: 2\nSitemap: http://e.org/s.xml"
    rules = robots.parse_robots(body, "webloom")
    assert rules.delay == 2 and rules.sitemaps == ["http://e.org/s.xml"]
    cases = {"/": True, "/private": False, "/private/open/x": True, "/a.pdf": False, "/a.pdf?x": True, "/robots.txt": True}
    assert {p: robots.is_allowed(body, "webloom", p) for p in cases} == cases
    assert not robots.is_allowed(body, "other", "/x") and robots.is_allowed(body, "nobody", "/x")


def test_sitemaps(spark):
    urls = b"<s:urlset xmlns:s='u'><s:url><s:loc> http://e.org/?a=1&amp;b=2 </s:loc></s:url><s:url><s:loc>http://e.org/2</s:loc></s:url>"
    assert sitemap.parse_sitemap(urls) == (["http://e.org/?a=1&b=2", "http://e.org/2"], [])  # broken off
    assert sitemap.parse_sitemap(gzip.compress(b"<sitemapindex><sitemap><loc>c</loc></sitemap></sitemapindex>")) == ([], ["c"])
    assert sitemap.parse_sitemap(b"<loc>x</loc>") == ([], []) and sitemap.parse_sitemap(b"\x1f\x8bxx") == ([], [])
    assert spark.createDataFrame([(bytearray(urls),)], "x binary").select(sitemap.locations(F.col("x")).alias("l")).first().l.pages[1] == "http://e.org/2"


def test_config():
    c = config.load("[crawl]\nmax_depth = 3\n[rank]\nweight = 1\n[peers]\nallow = ['a']")
    assert c.crawl.max_depth == 3 and c.rank.weight == 1 and c.crawl.batch == 32 and config.is_peer_allowed(c, "a")
    for bad in ("[crawl]\nnope = 1", "x = 1", "[crawl]\nmax_depth = 'a'", "[rank]\nweight = 99", "crawl = 1"):
        with pytest.raises(ValueError):
            config.load(bad)


def test_csv_sources(spark, tmp_path):
    (tmp_path / "hosts.csv").write_text("Host,hcrank10\nA.org,5\nb.org,bad\n,3\nc.org,99\n")
    assert {(r.host, r.centrality) for r in csvs.hosts(spark, str(tmp_path / "hosts.csv")).collect()} == {("a.org", 0.5), ("b.org", 0.0), ("c.org", 1.0)}
    (tmp_path / "r.csv").write_text('http://e.org/,f.warc,10,20\n"http://e.org/?a,b",f.warc,1,2\n,f.warc,1,2\nhttp://e.org/x,f.warc,x,2\n')
    assert {(r.url, r.offset) for r in csvs.records(spark, str(tmp_path / "r.csv")).collect()} == {("http://e.org/", 10), ("http://e.org/?a,b", 1)}
    (tmp_path / "s.txt").write_text("# c\n\nExample.org\nhttps://x.org/a#b\nnot a host\n")
    assert {(r.url, r.host) for r in csvs.seeds(spark, str(tmp_path / "s.txt")).collect()} == {("https://example.org/", "example.org"), ("https://x.org/a", "x.org")}


def test_warc_round_trip(spark, tmp_path):
    made = [warc.response(f"<http://e.org/{i}>", "2024-01-01T00:00:00Z", 200, [("Content-Type", "text/html")], b"body%d" % i * 50, truncated=i == 2) for i in range(5)]
    rows = [([{"k": k, "v": v} for k, v in h], bytearray(b)) for h, b in made]
    df = spark.createDataFrame(rows, f"headers {warc.HEADERS}, body binary").repartition(2)
    warc.write(df, str(tmp_path / "w"))
    back = warc.split_http(warc.read(spark, str(tmp_path / "w"))).withColumn("uri", warc.target_uri())
    got = {r.uri: r for r in back.collect()}
    assert set(got) == {f"http://e.org/{i}" for i in range(5)} and got["http://e.org/3"].payload == b"body3" * 50 and got["http://e.org/3"].status == 200
    again = warc.read_records(back.select("path", "offset", "length").filter("offset > 0")).collect()
    assert {bytes(r.body) for r in again} <= {bytes(b) for _, b in made} and again
    assert back.filter(warc.header("warc-truncated") == "length").count() == 1
    sealed = warc.seal(spark, str(tmp_path / "w")).collect()
    assert all(len(r.digest) == 64 for r in sealed) and len(sealed) == len(warc.discover(str(tmp_path / "w")))
    shard = warc.discover(str(tmp_path / "w"))[0]
    whole = open(shard, "rb").read()
    open(shard, "ab").write(whole[:20])
    assert warc.truncate_torn(shard) == len(whole)
    (tmp_path / "plain.warc").write_bytes(b"".join(gzip.decompress(warc.member(h, b)) for h, b in made))
    assert warc.read(spark, str(tmp_path / "plain.warc")).count() == 5
    with pytest.raises(ValueError):
        warc.parse_record(b"HTTP/1.1 200\r\n\r\n")


def test_query_parser():
    q = R.parse('Alpha "beta gamma" title:delta site:E.org/ body:"x y" site: "')
    assert [(c.words, c.fields) for c in q.clauses] == [(["alpha"], ("title", "body")), (["beta", "gamma"], ("title", "body")), (["delta"], ("title",)), (["x", "y"], ("body",)), (["site"], ("title", "body"))]
    assert q.hosts == ["e.org"] and R.parse("  ").empty and R.parse("well-known").clauses[0].words == ["well", "known"]
    assert R.clamp_page(99) == 20 and R.clamp_page(-1) == 0 and len(R.parse("a" * 600).clauses[0].words[0]) == 512


def test_warc_writes_add_shards(spark, tmp_path):
    """Each appending write keeps what others wrote; an overwriting one replaces it. Paths may be URIs."""
    def one(i):
        h, b = warc.response(f"http://e.org/{i}", "2024-01-01T00:00:00Z", 200, [], b"x%d" % i)
        return spark.createDataFrame([([{"k": k, "v": v} for k, v in h], b)], f"headers {warc.HEADERS}, body binary")

    path = f"file://{tmp_path}/w"
    for i in range(3):
        warc.write(one(i), path)
    assert sorted(r.uri for r in warc.read(spark, path).select(warc.target_uri().alias("uri")).collect()) == [f"http://e.org/{i}" for i in range(3)]
    assert len(warc.discover(path)) == len(warc.discover(str(tmp_path / "w"))) == 3 and warc.seal(spark, path).count() == 3
    warc.write(one(9), path, "overwrite")
    assert [r.uri for r in warc.read(spark, path).select(warc.target_uri().alias("uri")).collect()] == ["http://e.org/9"]
    assert not [p for p in (tmp_path / "w").iterdir() if p.name.endswith(".part")]


def test_warc_append_to_a_torn_shard(spark, tmp_path):
    shard = str(tmp_path / "s.warc.gz")
    made = [warc.response(f"http://e.org/{i}", "2024-01-01T00:00:00Z", 200, [], b"x%d" % i) for i in range(4)]
    warc.append(shard, made[:2])
    with open(shard, "ab") as f:
        f.write(warc.member(*made[2])[:20])
    places = warc.append(shard, made[2:])
    back = warc.read(spark, shard).collect()
    assert [bytes(r.body) for r in back] == [b for _, b in made] and [(r.offset, r.length) for r in back[2:]] == places
