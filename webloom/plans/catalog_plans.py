"""Catalog queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.operators import catalog as C
from webloom.plans.fixtures import ME, NOW, sql, view

HOST, URLS, DOCS = "id, host, state, in_flight, next_fetch_at", "id, url, host_id, next_attempt_at", "id, url, indexed, skip_reason"
DUE = f"state = 0 AND next_attempt_at <= {NOW}"



def _run(names, f):
    return lambda s, d: f(*[view(s, d, n) for n in names.split()])


def _cols(df, names):
    return df.select(*[c.strip() for c in names.split(",")])


CATALOG = {
    "ready_hosts": (_run("hosts", lambda h: _cols(C.ready_hosts(h, NOW), HOST)), sql(f"SELECT {HOST} FROM hosts WHERE state = 1 AND NOT in_flight AND next_fetch_at <= {NOW}")),
    "due_urls": (_run("frontier", lambda f: _cols(C.due_urls(f, NOW), URLS)), sql(f"SELECT {URLS} FROM frontier WHERE {DUE}")),
    "ingest_gate": (
        _run("docs", lambda d: d.select("id", C.is_ingestible(F.when(F.col("id") % 5 > 0, "response").otherwise("request"), F.col("url"), (200 + F.col("id") % 150).cast("int"), F.element_at(F.array(*map(F.lit, ("", "text/html", "Text/HTML; charset=utf-8", "image/png", "application/xhtml+xml"))), (F.col("id") % 5 + 1).cast("int"))).alias("ok"))),
        sql("SELECT id, id % 5 > 0 AND 200 + id % 150 BETWEEN 200 AND 299 AND id % 5 <> 3 AS ok FROM docs"),
    ),
    "gate_verdict": (
        _run("corpus", lambda c: c.select("id", C.gate(F.col("id") % 11 == 0, F.when(F.length("body") >= 400, F.col("body")), F.substring("host", 1, 4), ["src0", "src1", "src2"]).alias("verdict"))),
        sql("SELECT id, CASE WHEN id % 11 = 0 THEN 'noindex' WHEN length(body) < 400 THEN 'empty' WHEN host[:4] NOT IN ('src0', 'src1', 'src2') THEN 'lang' ELSE 'pending' END AS verdict FROM corpus"),
    ),
    "pending_docs": (_run("docs", lambda d: _cols(C.pending(d), DOCS)), sql(f"SELECT {DOCS} FROM docs WHERE indexed = 0")),
    "rebuild_exclusion": (_run("docs", lambda d: _cols(C.rebuildable(d), DOCS)), sql(f"SELECT {DOCS} FROM docs WHERE NOT (indexed = 2 AND skip_reason = 'error')")),
    "named_like": (_run("shards", lambda s: C.named_like(s, "name", "node1-").select("id", "name")), sql("SELECT id, name FROM shards WHERE name LIKE 'node1-%'")),
    "unfinished_shards": (_run("shards", lambda s: C.unfinished_shards(s, ME).select("id", "name", "origin")), sql(f"SELECT id, name, origin FROM shards WHERE ingested_at IS NULL AND state = 1 AND origin <> '{ME}'")),
    "offered_shards": (_run("shards", lambda s: C.offered_shards(s, ME).select("id", "name", "hash")), sql(f"SELECT id, name, hash FROM shards WHERE state = 1 AND origin = '{ME}' AND hash IS NOT NULL")),
    "credible_shards": (_run("shards", lambda s: C.credible(s, "peer2").select("id", "hash", "bytes")), sql("SELECT id, hash, bytes FROM shards WHERE origin = 'peer2' AND length(hash) = 64 AND bytes > 0")),
    "claim_join": (
        _run("hosts frontier docs", lambda h, f, d: C.claim(h, f, d, NOW, 32).select("host", "url", "next_fetch_at", "prior_sha")),
        sql(f"""WITH first AS (SELECT *, row_number() OVER (PARTITION BY host_id ORDER BY next_attempt_at, id) AS n FROM frontier WHERE {DUE}),
        jobs AS (SELECT h.host, f.url, h.next_fetch_at FROM hosts h JOIN first f ON f.host_id = h.id AND f.n = 1 WHERE h.state = 1 AND NOT in_flight AND next_fetch_at <= {NOW} ORDER BY next_fetch_at, h.id LIMIT 32)
        SELECT j.host, j.url, j.next_fetch_at, d.sha256 AS prior_sha FROM jobs j LEFT JOIN docs d ON d.url = j.url"""),
    ),
    "catalog_join": (
        _run("docs hosts shards", lambda d, h, s: C.with_hosts_and_shards(C.pending(d), h, s).select("id", "url", "host", "shard", "off")),
        sql("SELECT d.id, d.url, h.host, s.name AS shard, d.off FROM docs d JOIN hosts h ON h.id = d.host_id JOIN shards s ON s.id = d.shard_id WHERE d.indexed = 0"),
    ),
    "rebuild_join": (
        _run("docs hosts shards", lambda d, h, s: C.with_hosts_and_shards(C.rebuildable(d), h, s).repartition("shard_id").sortWithinPartitions("shard_id", "off").select("id", "host", "shard", "off")),
        sql("SELECT d.id, h.host, s.name AS shard, d.off FROM docs d JOIN hosts h ON h.id = d.host_id JOIN shards s ON s.id = d.shard_id WHERE NOT (indexed = 2 AND skip_reason = 'error')"),
    ),
    "pending_soon": (_run("frontier hosts", lambda f, h: C.pending_soon(f, h, NOW, 300)), sql(f"SELECT count(*) AS n FROM frontier f JOIN hosts h ON h.id = f.host_id WHERE h.state = 1 AND (f.state = 1 OR (f.state = 0 AND f.next_attempt_at <= {NOW + 300}))")),
    "stuck_hosts_anti": (
        _run("hosts frontier", lambda h, f: C.stuck_hosts(h, f.filter("claimed_at < 2990")).select("id", "host")),
        sql("SELECT id, host FROM hosts WHERE in_flight AND id NOT IN (SELECT host_id FROM frontier WHERE state = 1 AND claimed_at < 2990)"),
    ),
    "shard_diff_anti": (_run("shards", lambda s: C.unknown_shards(s, s.filter("ingested_at IS NOT NULL")).select("id", "hash")), sql("SELECT id, hash FROM shards WHERE hash NOT IN (SELECT hash FROM shards WHERE ingested_at IS NOT NULL)")),
    "inflight_exclusion": (_run("docs frontier", lambda d, f: C.without_ids(C.pending(d), f.filter("state = 0 AND depth = 1")).select("id", "url")), sql("SELECT id, url FROM docs WHERE indexed = 0 AND id NOT IN (SELECT id FROM frontier WHERE state = 0 AND depth = 1)")),
    "indexed_copies": (_run("docs", lambda d: C.indexed_copies(d).select("id", "sha256")), sql("SELECT id, sha256 FROM docs d WHERE EXISTS (SELECT 1 FROM docs o WHERE o.sha256 = d.sha256 AND o.url <> d.url AND o.indexed = 1)")),
    "change_detect": (
        _run("frontier docs", lambda f, d: C.changed(f, d, f.select("url", F.concat(F.lit("sha"), F.col("id") % 1009).alias("sha256")))),
        sql("SELECT f.url, d.sha256 IS DISTINCT FROM 'sha' || (f.id % 1009) AS changed FROM frontier f LEFT JOIN docs d ON d.url = f.url"),
    ),
    "status_gauges": (
        _run("hosts frontier docs shards", C.gauges),
        sql("""SELECT (SELECT count(*) FROM hosts WHERE state = 1) AS hosts_active, (SELECT count(*) FROM hosts WHERE in_flight) AS hosts_in_flight, (SELECT count(*) FROM frontier WHERE state = 0) AS urls_queued,
        (SELECT count(*) FROM frontier WHERE state = 1) AS urls_claimed, (SELECT count(*) FROM docs WHERE indexed = 0) AS docs_pending, (SELECT count(*) FROM docs WHERE indexed = 1) AS docs_indexed,
        (SELECT count(*) FROM docs WHERE indexed = 2) AS docs_skipped, (SELECT count(*) FROM docs) AS docs, (SELECT count(*) FROM shards WHERE state = 1) AS shards_sealed, (SELECT CAST(coalesce(sum(bytes), 0) AS BIGINT) FROM shards) AS shard_bytes"""),
    ),
    "foreign_bytes": (_run("shards", lambda s: C.foreign_bytes(s, ME)), sql(f"SELECT CAST(coalesce(sum(bytes), 0) AS BIGINT) AS used FROM shards WHERE origin <> '{ME}'")),
    "skip_histogram": (_run("docs", C.skip_histogram), sql("SELECT skip_reason, count(*) AS n FROM docs WHERE indexed = 2 GROUP BY skip_reason")),
    "edge_weights": (_run("page_links", C.edge_weights), sql("SELECT from_host, to_host, count(*) AS cnt FROM page_links WHERE from_host <> to_host GROUP BY ALL")),
    "edge_upsert": (
        _run("page_links links", lambda p, k: C.add_edges(C.edge_weights(p), C.edge_weights(k))),
        sql("SELECT from_host, to_host, count(*) AS cnt FROM (SELECT * FROM page_links UNION ALL SELECT * FROM links) WHERE from_host <> to_host GROUP BY ALL"),
    ),
    "next_sequence": (_run("shards", lambda s: C.next_sequence(s, "node2-")), sql("SELECT max(CAST(regexp_extract(name, '-(\\d+)$', 1) AS BIGINT)) + 1 AS next FROM shards WHERE name LIKE 'node2-%'")),
    "distinct_links": (_run("page_links", lambda p: p.distinct()), sql("SELECT DISTINCT from_host, to_host FROM page_links")),
    "top_per_host": (_run("frontier", lambda f: _cols(C.top_per_host(f, NOW), URLS)), sql(f"SELECT {URLS} FROM frontier WHERE {DUE} QUALIFY row_number() OVER (PARTITION BY host_id ORDER BY next_attempt_at, id) = 1")),
    "quota_prefix": (
        _run("shards", lambda s: C.within_quota(s.filter(F.col("origin") != ME), 500, 30000).select("id", "origin", "total")),
        sql(f"SELECT id, origin, total FROM (SELECT id, origin, CAST(500 + sum(bytes) OVER (PARTITION BY origin ORDER BY created_at, id) AS BIGINT) AS total FROM shards WHERE origin <> '{ME}') WHERE total <= 30000"),
    ),
    "admission_cap": (
        _run("frontier hosts", lambda f, h: C.admit(f.withColumn("arrival", F.col("id")), h, f.filter("state = 2"), 45, 3).select("id", "url", "host_id")),
        sql("""WITH fresh AS (SELECT f.*, h.urls_accepted FROM frontier f JOIN hosts h ON h.id = f.host_id WHERE h.state = 1 AND f.depth <= 3 AND f.url NOT IN (SELECT url FROM frontier WHERE state = 2))
        SELECT id, url, host_id FROM fresh QUALIFY row_number() OVER (PARTITION BY host_id ORDER BY id, url) <= 45 - urls_accepted"""),
    ),
    "accepted_at_arrival": (
        _run("snapshots", C.accepted_at_arrival),
        sql("""WITH m AS (SELECT *, max(fetched_at) OVER (PARTITION BY url ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM snapshots),
        n AS (SELECT *, lag(fetched_at) OVER w AS last_at, lag(sha256) OVER w AS last_sha FROM m WHERE best IS NULL OR fetched_at >= best WINDOW w AS (PARTITION BY url ORDER BY arrival))
        SELECT url, arrival, fetched_at, sha256 FROM n WHERE last_at IS NULL OR NOT (last_at = fetched_at AND last_sha = sha256)"""),
    ),
    "latest_snapshot": (
        _run("snapshots", C.newest_snapshot),
        sql("""WITH top AS (SELECT *, max(fetched_at) OVER (PARTITION BY url) AS best FROM snapshots), last AS (SELECT * FROM top WHERE fetched_at = best),
        runs AS (SELECT *, CASE WHEN lag(sha256) OVER w = sha256 THEN 0 ELSE 1 END AS begins FROM last WINDOW w AS (PARTITION BY url ORDER BY arrival))
        SELECT url, arrival, fetched_at, sha256 FROM runs WHERE begins = 1 QUALIFY row_number() OVER (PARTITION BY url ORDER BY arrival DESC) = 1"""),
    ),
    "expired_leases": (_run("frontier", lambda f: C.expired_leases(f, 2000).select("id", "claimed_at")), sql("SELECT id, claimed_at FROM frontier WHERE state = 1 AND claimed_at < 1100")),
    "boot_recovery": (_run("frontier", lambda f: C.recover(f).select("id", "state", "attempts")), sql("SELECT id, CASE WHEN state = 1 THEN 0 ELSE state END AS state, CASE WHEN state = 1 THEN greatest(attempts - 1, 0) ELSE attempts END AS attempts FROM frontier")),
    "archive_order": (_run("docs", lambda d: d.orderBy("shard_id", "off", "id").select("shard_id", "off", "id")), sql("SELECT shard_id, off, id FROM docs ORDER BY ALL")),
    "latest_open_shard": (_run("shards", lambda s: s.filter("state = 0").agg(F.max_by("name", "id").alias("name"))), sql("SELECT max_by(name, id) AS name FROM shards WHERE state = 0")),
    "oldest_catalog": (_run("shards", lambda s: s.orderBy("created_at", "id").select("id", "created_at").limit(10)), sql("SELECT id, created_at FROM shards ORDER BY created_at, id LIMIT 10")),
    "insert_or_ignore": (
        _run("frontier", lambda f: C.insert_or_ignore(f.filter("depth < 3").select("url", "depth", "id"), f.select(F.concat(F.lit("https://h"), "host_id", F.lit("/")).alias("url"), "depth", "id"), "url", "id")),
        sql("WITH more AS (SELECT 'https://h' || host_id || '/' AS url, depth, id FROM frontier QUALIFY row_number() OVER (PARTITION BY host_id ORDER BY id) = 1) SELECT url, depth, id FROM frontier WHERE depth < 3 UNION ALL SELECT * FROM more"),
    ),
    "upsert_overwrite": (
        _run("hosts frontier", lambda h, f: C.upsert(h.select("id", "state", "centrality"), f.groupBy(F.col("host_id").alias("id")).agg(F.lit(1).alias("state"), F.lit(0.5).alias("centrality")), "id", ["centrality"])),
        sql("WITH more AS (SELECT DISTINCT host_id AS id FROM frontier) SELECT coalesce(m.id, h.id) AS id, coalesce(h.state, 1) AS state, CASE WHEN m.id IS NULL THEN h.centrality ELSE 0.5 END AS centrality FROM hosts h FULL JOIN more m ON m.id = h.id"),
    ),
    "state_update": (
        _run("docs", lambda d: C.mark(d, d.filter("indexed = 0").select("id", F.lit(2).alias("indexed"), F.lit("dup-exact").alias("skip_reason"))).select("id", "indexed", "skip_reason")),
        sql("SELECT id, CASE WHEN indexed = 0 THEN 2 ELSE indexed END AS indexed, CASE WHEN indexed = 0 THEN 'dup-exact' ELSE skip_reason END AS skip_reason FROM docs"),
    ),
    "delete_before_add": (
        _run("docs", lambda d: C.replace_by_key(d.filter("indexed = 1").select("url", "fetched_at"), d.filter("indexed <> 0").select("url", F.lit(7).cast("bigint").alias("fetched_at")))),
        sql("SELECT url, CAST(7 AS BIGINT) AS fetched_at FROM docs WHERE indexed <> 0"),
    ),
    "hash_difference": (_run("docs", lambda d: d.filter("indexed = 0").select("sha256").subtract(d.filter("indexed = 1").select("sha256"))), sql("SELECT sha256 FROM docs WHERE indexed = 0 EXCEPT SELECT sha256 FROM docs WHERE indexed = 1")),
    "hash_intersection": (_run("docs", lambda d: d.filter("indexed = 0").select("sha256").intersect(d.filter("indexed = 1").select("sha256"))), sql("SELECT sha256 FROM docs WHERE indexed = 0 INTERSECT SELECT sha256 FROM docs WHERE indexed = 1")),
    "host_lookup": (_run("docs hosts", lambda d, h: d.join(h.select(F.col("id").alias("host_id"), "host", "centrality"), "host_id").select("id", "host", "centrality")), sql("SELECT d.id, h.host, h.centrality FROM docs d JOIN hosts h ON h.id = d.host_id")),
    "same_host_scope": (_run("page_links", lambda p: p.filter("from_host = to_host").agg(F.count("*").alias("n"))), sql("SELECT count(*) AS n FROM page_links WHERE from_host = to_host")),
    "unsurt_top_hosts": (
        _run("hosts", lambda h: h.filter("state = 1").select(F.array_join(F.reverse(F.split(F.array_join(F.reverse(F.split("host", r"\.")), ","), ",")), ".").alias("host"), "centrality").orderBy(F.desc("centrality"), "host").limit(20)),
        sql("SELECT host, centrality FROM hosts WHERE state = 1 ORDER BY centrality DESC, host LIMIT 20"),
    ),
    "record_pointer_semi": (_run("docs hosts", lambda d, h: d.join(h.filter("centrality > 0.5").select(F.col("id").alias("host_id")), "host_id", "left_semi").select("url", "shard_id", "off")), sql("SELECT url, shard_id, off FROM docs WHERE host_id IN (SELECT id FROM hosts WHERE centrality > 0.5)")),
    "record_pointer_join": (_run("docs hosts", lambda d, h: d.join(h.select(F.col("id").alias("host_id"), "host"), "host_id").select("url", "host", "shard_id", "off")), sql("SELECT url, host, shard_id, off FROM docs JOIN hosts h ON h.id = host_id")),
    "lifetime_counters": (_run("docs", lambda d: d.groupBy(F.concat(F.lit("ctr_"), F.coalesce("skip_reason", F.lit("ok"))).alias("name")).agg(F.count("*").alias("value"))), sql("SELECT 'ctr_' || coalesce(skip_reason, 'ok') AS name, count(*) AS value FROM docs GROUP BY 1")),
    "failure_log": (_run("docs", lambda d: d.filter("skip_reason IS NOT NULL").select("url", F.replace(F.concat("skip_reason", F.lit(", code "), "indexed"), F.lit(","), F.lit(";")).alias("reason"))), sql("SELECT url, replace(skip_reason || ', code ' || indexed, ',', ';') AS reason FROM docs WHERE skip_reason IS NOT NULL")),
    "shard_rotation": (_run("docs", lambda d: C.rotate(d.select(F.col("shard_id").alias("writer"), F.floor(F.col("off") / 100_000).alias("batch"), "id", (F.col("id") % 900 + 100).alias("bytes")), 20_000)), None),
}
