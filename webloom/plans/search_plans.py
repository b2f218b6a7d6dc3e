"""Retrieval queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.functions.text import lead_snippet, tokens
from webloom.operators import retrieval as R
from webloom.operators.catalog import interleave
from webloom.plans.fixtures import sql, view

WORDS = "with from"
TOKS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '')"


def _field(name: str) -> str:
    return TOKS.format(name)


def bm25_sql(clauses: list[tuple[list[str], list[str]]], tail: str, weight: float = 0.0, where: str = "") -> str:
    """clauses: (words, fields). tail: what to select from s (id, url, host, score)."""
    cols, stats, score, has = [], [], [], []
    for i, (words, fields) in enumerate(clauses):
        any_field = []
        for f in fields:
            name = f"{i}_{f}"
            if len(words) == 1:
                tf = f"len(list_filter({f}_t, lambda x: x = '{words[0]}'))"
            else:
                same = " AND ".join(f"{f}_t[i + {k}] = '{w}'" for k, w in enumerate(words))
                tf = f"len(list_filter(range(1, len({f}_t) + 1), lambda i: coalesce({same}, false)))"
            cols.append(f"{tf} AS tf_{name}")
            stats.append(f"count(*) FILTER (tf_{name} > 0) AS df_{name}")
            idf = f"ln(1 + (n - df_{name} + 0.5) / (df_{name} + 0.5))"
            score.append(f"CASE WHEN tf_{name} > 0 THEN {2.0 if f == 'title' else 1.0} * {idf} * tf_{name} * 2.2 / (tf_{name} + 1.2 * (0.25 + 0.75 * len({f}_t) / greatest(avg_{f}, 1e-9))) ELSE 0 END")
            any_field.append(f"tf_{name} > 0")
        has.append("(" + " OR ".join(any_field) + ")")
    return sql(f"""WITH t AS (SELECT id, url, host, centrality, {_field("title")} AS title_t, {_field("body")} AS body_t FROM corpus), c AS (SELECT *, {", ".join(cols)} FROM t),
    st AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(title_t)) AS avg_title, avg(len(body_t)) AS avg_body, {", ".join(stats)} FROM c),
    s AS (SELECT id, url, host, ({" + ".join(score)}) * (1 + {weight} * centrality) AS score FROM c, st WHERE {" AND ".join(has)} {where})
    {tail}""")


def _search(text, weight=0.0, size=10, page=0):
    return lambda s, d: R.top(R.scored(view(s, d, "corpus"), R.parse(text), weight), size, page).select("id", F.round("score", 6).alias("score"))


BOTH = ["title", "body"]
TWO = [(["with"], BOTH), (["from"], BOTH)]
TOP = "SELECT id, round(score, 6) AS score FROM s ORDER BY s.score DESC, url LIMIT 10"


def FLAGSHIP(spark, sf_dir):
    return SEARCH["centrality_boost"][0](spark, sf_dir)


def _fed(s, d):
    c = view(s, d, "corpus")
    lists = []
    for i, host in enumerate(("src1.example.org", "src2.example.org", "src3.example.org")):
        hits = R.top(R.scored(c.filter(F.col("host") == host), R.parse(WORDS), 0.0), 8)
        ranked = hits.select("url", "score", F.lit(i).alias("list_idx"))
        lists.append(ranked.withColumn("pos", F.row_number().over(R_window())))
    both = lists[0].unionByName(lists[1]).unionByName(lists[2]).unionByName(lists[0].withColumn("list_idx", F.lit(3)))
    return interleave(both, 12).select("url", "turn", "list_idx")


def R_window():
    from pyspark.sql import Window

    return Window.partitionBy("list_idx").orderBy(F.desc("score"), "url")


def _fed_sql() -> str:
    parts = []
    body = bm25_sql([(["with"], BOTH), (["from"], BOTH)], "")
    for i, host in enumerate(("src1.example.org", "src2.example.org", "src3.example.org")):
        one = body.replace("FROM corpus), c AS", f"FROM corpus WHERE host = '{host}'), c AS")
        parts.append(f"SELECT url, {i} AS list_idx, row_number() OVER (ORDER BY score DESC, url) AS pos FROM ({one} SELECT * FROM s ORDER BY score DESC, url LIMIT 8)")
    return f"""WITH l AS ({" UNION ALL ".join(parts)}), four AS (SELECT * FROM l UNION ALL SELECT url, 3, pos FROM l WHERE list_idx = 0),
    t AS (SELECT url, list_idx, row_number() OVER (PARTITION BY list_idx ORDER BY pos) AS turn FROM four)
    SELECT url, turn, list_idx FROM (SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY url ORDER BY turn, list_idx) = 1) ORDER BY turn, list_idx LIMIT 12"""


SEARCH = {
    "bm25_topk": (_search("body:with body:from"), bm25_sql([(["with"], ["body"]), (["from"], ["body"])], TOP)),
    "bm25_title_boost": (_search(WORDS), bm25_sql(TWO, TOP)),
    "phrase_match": (_search('"of the" with'), bm25_sql([(["of", "the"], BOTH), (["with"], BOTH)], TOP)),
    "field_prefix": (_search("title:of with"), bm25_sql([(["of"], ["title"]), (["with"], BOTH)], TOP)),
    "site_filter": (_search("with site:SRC1.example.org/ site:src2.example.org"), bm25_sql([(["with"], BOTH)], TOP, where="AND host IN ('src1.example.org', 'src2.example.org')")),
    "site_only": (lambda s, d: R.scored(view(s, d, "corpus"), R.parse("site:src4.example.org"), 0.0), sql("SELECT id, url, host, CAST(1 AS DOUBLE) AS score FROM corpus WHERE host = 'src4.example.org'")),
    "centrality_boost": (_search(WORDS, 0.3), bm25_sql(TWO, TOP, 0.3)),
    "search_page2": (_search(WORDS, 0.3, 10, 1), bm25_sql(TWO, TOP + " OFFSET 10", 0.3)),
    "page_clamp": (_search(WORDS, 0.3, 3, 99), bm25_sql(TWO, TOP.replace("LIMIT 10", "LIMIT 3 OFFSET 60"), 0.3)),
    "search_total": (lambda s, d: R.total(view(s, d, "corpus"), WORDS, stemming=False), bm25_sql(TWO, "SELECT count(*) AS total FROM s")),
    "empty_query": (_search("   "), sql("SELECT id, CAST(0 AS DOUBLE) AS score FROM corpus WHERE false")),
    "search_stemmed": (lambda s, d: R.search(view(s, d, "corpus"), "with from"), None),
    "postings": (
        lambda s, d: R.postings(view(s, d, "corpus")).select("term", "field", "id", "tf", F.get("positions", F.lit(0)).alias("first")),
        sql(f"""WITH t AS (SELECT id, 'title' AS field, {_field("title")} AS toks FROM corpus UNION ALL SELECT id, 'body', {_field("body")} FROM corpus), p AS (SELECT id, field, unnest(toks) AS term, unnest(range(0, len(toks))) AS pos FROM t)
        SELECT term, field, id, count(*) AS tf, CAST(min(pos) AS INT) AS first FROM p GROUP BY ALL"""),
    ),
    "term_stats": (
        lambda s, d: R.term_stats(R.postings(view(s, d, "corpus"), positions=False)),
        sql(f"""WITH t AS (SELECT id, 'title' AS field, {_field("title")} AS toks FROM corpus UNION ALL SELECT id, 'body', {_field("body")} FROM corpus), p AS (SELECT id, field, unnest(toks) AS term FROM t)
        SELECT term, field, count(DISTINCT id) AS df, count(*) AS cf FROM p GROUP BY ALL"""),
    ),
    "doc_lengths": (lambda s, d: R.lengths(view(s, d, "corpus")).groupBy("field").agg(F.count("*").alias("n"), F.round(F.avg("len"), 6).alias("avg_len")), sql(f"WITH t AS (SELECT 'title' AS field, {_field('title')} AS toks FROM corpus UNION ALL SELECT 'body', {_field('body')} FROM corpus) SELECT field, count(*) AS n, round(avg(len(toks)), 6) AS avg_len FROM t GROUP BY field")),
    "fed_round_robin": (_fed, _fed_sql()),
    "snippet_lead": (lambda s, d: view(s, d, "corpus").select("id", lead_snippet(F.col("body")).alias("snippet")), sql("""SELECT id, replace(replace(replace(replace(replace(body[:200], '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#39;') || CASE WHEN length(body) > 200 THEN '…' ELSE '' END AS snippet FROM corpus""")),
    "analyzer": (lambda s, d: view(s, d, "corpus").select("id", F.array_join(tokens(F.col("body")), " ").alias("toks")), sql(f"SELECT id, array_to_string({_field('body')}, ' ') AS toks FROM corpus")),
}
