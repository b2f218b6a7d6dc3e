"""Scalar queries over pages, documents and derived columns, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.functions import hashing, html, text, times, url
from webloom.plans.fixtures import sql, view
from webloom.tables import table


def _on(name, columns):
    """The columns are made when the query is, as they need a session."""
    return lambda s, d: table(s, d, name).select(*columns())


def _over(name, columns):
    return lambda s, d: view(s, d, name).select(*columns())


def _link():
    return F.concat(F.lit("https://e.org/p"), F.col("page_id"), F.lit("?utm_source=a&id="), F.col("page_id").cast("string"), F.lit("&gclid=1&utm_campaign=b&q=2#top"))


HEADERS = "array(struct('Content-Type' AS k, 'text/html' AS v), struct('Connection' AS k, 'close' AS v), struct('content-type' AS k, concat('x', page_id) AS v))"
REGEX_TEXT = r"trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', ' ', 'g'), '(?is)<head[ >].*?</head>', ' ', 'g'), '(?is)<script[ >].*?</script>', ' ', 'g'), '(?is)<style[ >].*?</style>', ' ', 'g'), '(?is)<noscript[ >].*?</noscript>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"
LINKS_SQL = r"""list_distinct(list_filter(list_transform(list_filter(regexp_extract_all(html, '(?i)<a\s[^>]*>'), lambda t: NOT regexp_matches(t, '(?i)rel\s*=\s*.?[^>]*nofollow')), lambda t: regexp_extract(t, '(?i)href\s*=\s*["'']([^"'']*)["'']', 1)), lambda h: h <> ''))"""

SCALAR = {
    "url_host": (_on("pages", lambda: [F.col("page_id"), url.host_of(F.col("url")).alias("host")]), "SELECT page_id, regexp_extract(lower(url), '^https?://([^/:?#]+)', 1) AS host FROM pages"),
    "url_strip_tracking": (_on("pages", lambda: [F.col("page_id"), url.strip_tracking(_link()).alias("clean")]), "SELECT page_id, 'https://e.org/p' || page_id || '?id=' || page_id || '&q=2' AS clean FROM pages"),
    "url_tracking_param": (_on("pages", lambda: [F.col("page_id"), url.is_tracking(F.element_at(F.array(*map(F.lit, ("utm_x", "gclid", "id", "fbclid", "utm"))), (F.col("page_id") % 5 + 1).cast("int"))).alias("tracking")]), "SELECT page_id, page_id % 5 IN (0, 1, 3) AS tracking FROM pages"),
    "url_normalize": (_on("pages", lambda: [F.col("page_id"), url.normalize(F.concat(F.lit("HTTPS://U:p@Example.COM:443/a/../"), F.col("page_id").cast("string"), F.lit("/./?utm_x=1&k=v#f"))).alias("clean")]), "SELECT page_id, 'https://example.com/' || page_id || '/?k=v' AS clean FROM pages"),
    "url_relative": (_on("pages", lambda: [F.col("page_id"), url.normalize(F.concat(F.lit("../x"), F.col("page_id").cast("string")), F.lit("http://example.com/a/b/c?d")).alias("clean")]), "SELECT page_id, 'http://example.com/a/x' || page_id AS clean FROM pages"),
    "url_seed_entry": (_on("pages", lambda: [F.col("page_id"), url.seed_entry(F.when(F.col("page_id") % 3 == 0, F.concat(F.lit(" Host"), F.col("page_id"), F.lit(".Example.org "))).when(F.col("page_id") % 3 == 1, F.col("url")).otherwise("no such thing")).alias("seed")]), "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'https://host' || page_id || '.example.org/' WHEN page_id % 3 = 1 THEN url END AS seed FROM pages"),
    "robots_url": (_on("pages", lambda: [F.col("page_id"), url.robots_url(F.col("url")).alias("robots")]), "SELECT page_id, regexp_replace(url, '^(https?://[^/?#]+).*$', '\\1/robots.txt') AS robots FROM pages"),
    "url_unsurt": (_on("pages", lambda: [F.col("page_id"), url.unsurt(F.concat(F.lit("org,example,h"), F.col("page_id"))).alias("host")]), "SELECT page_id, 'h' || page_id || '.example.org' AS host FROM pages"),
    "urlencode": (_on("documents", lambda: ["doc_id", text.urlencode(F.substring("text", 1, 60)).alias("coded")]), "SELECT doc_id, url_encode(text[:60]) AS coded FROM documents"),
    "title_extract": (_on("pages", lambda: [F.col("page_id"), html.title(F.col("html")).alias("title")]), r"SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) AS title FROM pages"),
    "link_extract": (
        lambda s, d: table(s, d, "pages").select("page_id", F.explode(html.links(F.col("html"))).alias("href")),
        f"SELECT page_id, unnest({LINKS_SQL}) AS href FROM pages",
    ),
    "meta_robots": (
        _on("pages", lambda: [F.col("page_id"), html.meta_robots(F.concat(F.col("html"), F.when(F.col("page_id") % 2 == 0, '<META content="NoIndex, follow" name="robots">').otherwise("")), "noindex").alias("noindex")]),
        "SELECT page_id, page_id % 2 = 0 AS noindex FROM pages",
    ),
    "text_fallback": (_on("pages", lambda: [F.col("page_id"), html.fallback_text(F.col("html")).alias("text")]), f"SELECT page_id, {REGEX_TEXT} AS text FROM pages"),
    "squash_space": (_on("documents", lambda: ["doc_id", text.squash(F.col("text")).alias("text")]), r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM documents"),
    "title_default": (_on("documents", lambda: ["doc_id", text.default_title(F.when(F.col("doc_id") % 2 == 0, "").otherwise("t"), F.col("text")).alias("title")]), "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN text[:80] ELSE 't' END AS title FROM documents"),
    "html_escape": (_on("pages", lambda: [F.col("page_id"), text.html_escape(F.col("html")).alias("escaped"), (text.html_unescape(text.html_escape(F.col("html"))) == F.col("html")).alias("back")]), "SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS escaped, true AS back FROM pages"),
    "header_value": (_on("pages", lambda: [F.col("page_id"), text.header_value(F.concat(F.lit("HTTP/1.1 200\r\nX: 1\r\ncontent-type:  a"), F.col("page_id").cast("string"), F.lit(" \r\nContent-Type: b")), "Content-Type").alias("value")]), "SELECT page_id, 'a' || page_id AS value FROM pages"),
    "first_header": (_on("pages", lambda: [F.col("page_id"), text.first_header(F.expr(HEADERS), "CONTENT-TYPE").alias("value")]), "SELECT page_id, 'text/html' AS value FROM pages"),
    "hop_headers": (_on("pages", lambda: [F.col("page_id"), F.to_json(text.strip_hop_headers(F.expr(HEADERS), F.length("html"))).alias("headers")]), """SELECT page_id, '[{"k":"Content-Type","v":"text/html"},{"k":"content-type","v":"x' || page_id || '"},{"k":"content-length","v":"' || length(html) || '"}]' AS headers FROM pages"""),
    "sha256_payload": (_on("documents", lambda: ["doc_id", hashing.sha256(F.col("text")).alias("sha256")]), "SELECT doc_id, sha256(text) AS sha256 FROM documents"),
    "sha256_hex": (_on("documents", lambda: [F.hex(F.unhex(hashing.sha256(F.col("text")))).alias("hex"), "doc_id"]), "SELECT doc_id, upper(sha256(text)) AS hex FROM documents"),
    "iso8601": (
        _over("docs", lambda: ["id", times.iso8601(F.col("fetched_at")).alias("at"), times.parse_iso8601(times.iso8601(F.col("fetched_at"))).alias("back"), times.parse_iso8601(F.concat(times.iso8601(F.col("fetched_at")), F.lit("x"))).alias("bad")]),
        sql("SELECT id, strftime(make_timestamp(fetched_at * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS at, fetched_at AS back, CAST(NULL AS BIGINT) AS bad FROM docs"),
    ),
    "gate_at": (_over("hosts", lambda: ["id", times.gate_at(F.col("next_fetch_at") * 777, F.col("crawl_delay_ms") - 700).alias("at")]), sql("SELECT id, CAST(ceil((next_fetch_at * 777 + greatest(crawl_delay_ms - 700, 0)) / 1000.0) AS BIGINT) AS at FROM hosts")),
    "retry_schedule": (_over("frontier", lambda: ["id", times.retry_at(F.lit(1000).cast("bigint"), F.col("id") % 7).alias("at")]), sql("SELECT id, CAST(1000 + 60 * power(4, least(greatest(id % 7, 1), 4) - 1) AS BIGINT) AS at FROM frontier")),
    "politeness_delay": (_over("hosts", lambda: ["id", times.effective_delay(F.lit(1000), F.col("crawl_delay_ms") * 20, F.col("crawl_delay_ms")).alias("ms")]), sql("SELECT id, greatest(1000, least(crawl_delay_ms * 20, 30000), crawl_delay_ms) AS ms FROM hosts")),
    "sticky_429": (_over("hosts", lambda: ["id", times.sticky_delay(F.col("crawl_delay_ms"), F.lit(1000), F.lit(3000)).alias("ms")]), sql("SELECT id, least(2 * greatest(crawl_delay_ms, 1000), 3000) AS ms FROM hosts")),
    "retry_after": (
        _over("hosts", lambda: ["id", F.coalesce(times.retry_after(F.when(F.col("id") % 3 == 0, F.lit("Wed, 21 Oct 2015")).otherwise(F.concat(F.lit(" "), F.col("id")))), F.lit(-1)).alias("wait"), times.unavailable_wait(F.when(F.col("id") % 3 == 0, F.lit("-5")).otherwise((F.col("id") * 100).cast("string"))).alias("wait_503")]),
        sql("SELECT id, CASE WHEN id % 3 = 0 THEN -1 ELSE id END AS wait, CASE WHEN id % 3 = 0 THEN 60 ELSE least(greatest(id * 100, 1), 3600) END AS wait_503 FROM hosts"),
    ),
    "rank_clamp": (_over("hosts", lambda: ["id", F.round(times.clamp_rank(F.when(F.col("id") % 4 == 0, F.lit("bad")).otherwise((F.col("id") - 20).cast("string"))), 6).alias("c")]), sql("SELECT id, CASE WHEN id % 4 = 0 THEN 0.0::DOUBLE ELSE round(least(greatest((id - 20) / 10.0, 0), 1)::DOUBLE, 6) END AS c FROM hosts")),
    "json_sink": (_over("docs", lambda: ["id", F.to_json(F.struct("id", "url", "indexed")).alias("json")]), sql("""SELECT id, '{"id":' || id || ',"url":"' || url || '","indexed":' || indexed || '}' AS json FROM docs""")),
    "main_text": (lambda s, d: table(s, d, "pages").select("page_id", html.extract(F.col("html"), F.col("url")).alias("x")).select("page_id", "x.title", "x.text", F.size("x.links").alias("n_links"), "x.noindex"), None),
    "language_guess": (_on("documents", lambda: ["doc_id", text.language(F.col("text")).alias("lang")]), None),
    "snippet_window": (_on("documents", lambda: ["doc_id", text.snippet(F.col("text"), ["the", "von", "de"]).alias("snippet")]), None),
}
