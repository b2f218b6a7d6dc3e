"""From archive files to a searchable snapshot: scan, gate, extract, newest wins, duplicate gates, index, swap.

A snapshot is a directory of Parquet tables; CURRENT names the one in use and is replaced only when all are written.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.functions import html, text, times, url
from webloom.operators import catalog, dedup, graph, retrieval
from webloom.session import materialize
from webloom.sources import files, warc
from webloom.sources.config import Config


def responses(spark: SparkSession, path: str) -> DataFrame:
    """(path, offset, url, fetched_at, content_type, sha256, html) of the archived pages that may be ingested."""
    r = warc.split_http(warc.read(spark, path))
    kind, content_type = warc.header("WARC-Type"), text.header_value(F.col("http_head"), "Content-Type")
    r = r.withColumns({"url": url.normalize(warc.target_uri()), "kind": kind, "content_type": content_type, "fetched_at": times.parse_iso8601(warc.header("WARC-Date"))})
    r = r.filter(catalog.is_ingestible(F.col("kind"), F.col("url"), F.col("status"), F.col("content_type")))

    @F.arrow_udf("string")
    def decoded(raw: pa.Array, types: pa.Array) -> pa.Array:
        return pa.array([None if x is None else html.decode_html(x, t) for x, t in zip(raw.to_pylist(), types.to_pylist())], pa.string())

    return r.select("path", "offset", "url", "fetched_at", F.sha2("payload", 256).alias("sha256"), decoded("payload", "content_type").alias("html"))


def build(spark: SparkSession, archive: str, languages: list[str]) -> tuple[DataFrame, DataFrame]:
    """(docs, links): every newest page with its verdict, and the weights of links between hosts."""
    pages = materialize(responses(spark, archive).withColumn("arrival", F.struct("path", "offset")), "pages")
    taken = catalog.accepted_at_arrival(pages)
    x = taken.withColumn("x", html.extract(F.col("html"), F.col("url"))).select("*", "x.*").drop("x", "html")
    x = materialize(x.withColumns({"host": url.host_of(F.col("url")), "lang": text.language(F.col("text"))}), "extracted")
    found = x.select(F.col("host").alias("from_host"), F.explode("links").alias("to")).withColumn("to_host", url.host_of(F.col("to")))
    links = catalog.edge_weights(found.select("from_host", "to_host"))
    docs = materialize(catalog.newest_snapshot(x).withColumn("id", F.monotonically_increasing_id()).drop("links", "arrival"), "newest")
    docs = docs.withColumn("verdict", catalog.gate(F.col("noindex"), F.col("text"), F.col("lang"), languages))
    clean = docs.filter("verdict = 'pending'")
    judged = dedup.gate_duplicates(clean.select("id", "sha256").join(dedup.simhash(clean), "id")).withColumnRenamed("verdict", "copy")
    docs = docs.join(judged, "id", "left").withColumn("verdict", F.coalesce("copy", "verdict")).drop("copy", "noindex")
    return materialize(docs, "docs"), links


def rebuild(spark: SparkSession, archive: str, out: str, config: Config | None = None) -> str:
    """Builds a snapshot beside the current one and swaps it in; its path."""
    config = config or Config()
    docs, links = build(spark, archive, config.index.languages)
    path = f"{out.rstrip('/')}/snapshot-{uuid.uuid4().hex[:12]}"
    links.write.parquet(f"{path}/links")
    ranks = spark.createDataFrame([], "node string, pct double")
    if links.take(1):
        ranks = graph.percentile(graph.centrality(spark.read.parquet(f"{path}/links"), force=True)).select("node", "pct")
    docs = docs.join(ranks.select(F.col("node").alias("host"), F.col("pct").alias("centrality")), "host", "left").fillna(0.0, ["centrality"])
    docs.write.partitionBy("verdict").parquet(f"{path}/docs")
    searchable(spark, path).transform(lambda d: retrieval.write_index(d, f"{path}/index") or d)
    files.replace(f"{out.rstrip('/')}/CURRENT", path.rsplit("/", 1)[1].encode())
    return path


def current(out: str) -> str:
    return f"{out.rstrip('/')}/{files.read(out.rstrip('/') + '/CURRENT').decode()}"


def searchable(spark: SparkSession, path: str) -> DataFrame:
    """The indexed documents of a snapshot; the verdict prunes partitions."""
    docs = spark.read.parquet(f"{path}/docs").filter("verdict = 'index'")
    return docs.select("id", "url", "host", text.default_title(F.col("title"), F.col("text")).alias("title"), F.col("text").alias("body"), "lang", "fetched_at", "centrality")


def status(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/docs").groupBy("verdict").agg(F.count("*").alias("n"))
