"""Graph queries with their SQL, over hosts that share a link path, each linked to the next by name."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from webloom.functions import html, url
from webloom.operators import graph as G
from webloom.plans.fixtures import sql, view
from webloom.plans.scalar_plans import LINKS_SQL
from webloom.tables import table


def chain(s, d):
    """(from_host, to_host): the hosts that have a link path in common, each to its successor."""
    p = table(s, d, "pages").select(url.host_of(F.col("url")).alias("host"), F.explode(html.links(F.col("html"))).alias("href")).distinct()
    nxt = F.lead("host").over(Window.partitionBy("href").orderBy("host"))
    return p.select(F.col("host").alias("from_host"), nxt.alias("to_host")).filter("to_host IS NOT NULL").distinct()


EDGES = f"""p AS (SELECT DISTINCT regexp_extract(lower(url), '^https?://([^/:?#]+)', 1) AS host, href FROM (SELECT url, unnest({LINKS_SQL}) AS href FROM pages)),
e AS (SELECT DISTINCT src, dst FROM (SELECT host AS src, lead(host) OVER (PARTITION BY href ORDER BY host) AS dst FROM p) WHERE dst IS NOT NULL AND dst <> src)"""
SCORES = f"""WITH RECURSIVE {EDGES}, r(src, dst, d) AS (SELECT src, dst, 1 FROM e UNION SELECT r.src, e.dst, r.d + 1 FROM r JOIN e ON e.src = r.dst WHERE e.dst <> r.src AND r.d < 60),
m AS (SELECT src, dst, min(d) AS d FROM r GROUP BY ALL), n AS (SELECT src AS node FROM e UNION SELECT dst FROM e),
s AS (SELECT n.node, coalesce(sum(1.0::DOUBLE / m.d), 0) AS score FROM n LEFT JOIN m ON m.dst = n.node GROUP BY n.node)"""


def _scores(s, d):
    return G.harmonic_exact(chain(s, d)).select("node", F.round("score", 6).alias("score"))


def _weighted(s, d):
    return view(s, d, "page_links").filter("from_host <> to_host").groupBy(F.col("to_host").alias("node")).agg(F.count("*").cast("double").alias("score"))


GRAPH = {
    "host_graph": (lambda s, d: G.graph(chain(s, d))[1], f"WITH {EDGES} SELECT src, dst FROM e"),
    "harmonic_exact": (_scores, f"{SCORES} SELECT node, round(score, 6) AS score FROM s"),
    "percentile_rank": (
        lambda s, d: G.percentile(_weighted(s, d)).select("node", F.round("pct", 6).alias("pct")),
        sql("""WITH s AS (SELECT to_host AS node, CAST(count(*) AS DOUBLE) AS score FROM page_links WHERE from_host <> to_host GROUP BY to_host)
        SELECT node, round((row_number() OVER (ORDER BY score, node) - 1) / CAST(count(*) OVER () - 1 AS DOUBLE), 6) AS pct FROM s"""),
    ),
    "rank_writeback": (
        lambda s, d: G.write_back(view(s, d, "hosts"), G.percentile(_weighted(s, d))).select("id", F.round("centrality", 6).alias("centrality")),
        sql("""WITH s AS (SELECT to_host AS node, CAST(count(*) AS DOUBLE) AS score FROM page_links WHERE from_host <> to_host GROUP BY to_host),
        r AS (SELECT node, (row_number() OVER (ORDER BY score, node) - 1) / CAST(count(*) OVER () - 1 AS DOUBLE) AS pct FROM s) SELECT h.id, round(coalesce(r.pct, h.centrality), 6) AS centrality FROM hosts h LEFT JOIN r ON r.node = h.id"""),
    ),
    "hyperball": (lambda s, d: G.hyperball(chain(s, d)).select("node", F.round("score", 6).alias("score")), None),
}
