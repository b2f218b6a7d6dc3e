"""Catalog tables derived from the test tables, by expressions that Spark and the SQL oracle both read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from webloom.tables import table

NOW, ME = 500, "peer0"

VIEWS: dict[str, tuple[str, list[str]]] = {
    "hosts": ("supplier", [
        "CAST(s_suppkey AS BIGINT) AS id", "'h' || s_suppkey || '.example.org' AS host", "CAST(s_nationkey % 3 AS INT) AS state", "s_suppkey % 7 = 0 AS in_flight",
        "CAST((s_suppkey * 37) % 1000 AS BIGINT) AS next_fetch_at", "CAST(s_nationkey * 100 AS BIGINT) AS crawl_delay_ms", "CAST(s_suppkey % 50 AS BIGINT) AS urls_accepted", "CAST(s_nationkey AS DOUBLE) / 25 AS centrality",
    ]),
    "frontier": ("orders", [
        "CAST(o_orderkey AS BIGINT) AS id", "'https://h' || (o_custkey % 100 + 1) || '.example.org/p' || o_orderkey AS url", "CAST(o_custkey % 100 + 1 AS BIGINT) AS host_id", "CAST(o_orderkey % 3 AS INT) AS state",
        "CAST((o_orderkey * 31) % 2000 AS BIGINT) AS next_attempt_at", "CAST(o_orderkey % 4 AS INT) AS attempts", "CAST(o_orderkey % 5 AS INT) AS depth", "CAST((o_orderkey * 17) % 3000 AS BIGINT) AS claimed_at",
    ]),
    "docs": ("orders", [
        "CAST(o_orderkey AS BIGINT) AS id", "'https://h' || (o_custkey % 100 + 1) || '.example.org/p' || o_orderkey AS url", "CAST(o_custkey % 100 + 1 AS BIGINT) AS host_id", "CAST(o_orderkey % 25 AS BIGINT) AS shard_id",
        "CAST(o_orderkey * 512 AS BIGINT) AS off", "'sha' || (o_custkey * 7 % 1009) AS sha256", "CAST(o_orderkey % 3 AS INT) AS indexed",
        "CASE WHEN o_orderkey % 3 <> 2 THEN NULL WHEN o_orderkey % 5 = 0 THEN 'error' WHEN o_orderkey % 5 = 1 THEN 'lang' WHEN o_orderkey % 5 = 2 THEN 'dup-near' ELSE 'noindex' END AS skip_reason",
        "CAST(1700000000 + (o_custkey * 7919) % 100000 AS BIGINT) AS fetched_at",
    ]),
    "snapshots": ("orders", ["'u' || o_custkey AS url", "CAST(o_orderkey AS BIGINT) AS arrival", "CAST((o_orderkey * 13) % 7 AS BIGINT) AS fetched_at", "'s' || ((o_orderkey * 5) % 3) AS sha256"]),
    "page_links": ("orders", ["CAST(o_custkey % 61 AS BIGINT) AS from_host", "CAST((o_orderkey * 7) % 61 AS BIGINT) AS to_host"]),
    "links": ("supplier", ["CAST(s_suppkey AS BIGINT) AS from_host", "CAST((s_suppkey * 3) % 17 + 1 AS BIGINT) AS to_host"]),
    "shards": ("nation", [
        "CAST(n_nationkey AS BIGINT) AS id", "'node' || n_regionkey || '-' || n_nationkey AS name", "'peer' || n_regionkey AS origin", "CAST((n_nationkey + 1) * 1000 AS BIGINT) AS bytes", "CAST((n_nationkey * 7) % 25 AS BIGINT) AS created_at",
        "CAST(n_nationkey % 3 AS INT) AS state", "CASE WHEN n_nationkey % 6 = 5 THEN 'short' ELSE md5(n_name) || md5(n_name) END AS hash", "CASE WHEN n_nationkey % 4 = 0 THEN NULL ELSE CAST(n_nationkey AS BIGINT) END AS ingested_at",
    ]),
    "corpus": ("documents", [
        "doc_id AS id", "'https://' || source || '.example.org/d' || doc_id AS url", "source || '.example.org' AS host", "split_part(text, '.', 1) AS title", "text AS body", "CAST(doc_id % 100 AS DOUBLE) / 100 AS centrality",
    ]),
}

WITH = "WITH " + ", ".join(f"{name} AS (SELECT {', '.join(columns)} FROM {base})" for name, (base, columns) in VIEWS.items())


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    base, columns = VIEWS[name]
    return table(spark, sf_dir, base).selectExpr(*columns)


def sql(body: str) -> str:
    """A query over the derived tables; one of its own WITH goes on after them."""
    body = body.strip()
    return WITH + (", " + body[5:] if body.upper().startswith("WITH ") else " " + body)
