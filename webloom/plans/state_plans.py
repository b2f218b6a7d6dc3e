"""State-machine and streaming queries with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.functions.url import host_of
from webloom.operators import catalog as C
from webloom.plans.fixtures import NOW, sql, view
from webloom.sources import robots
from webloom.streaming import outcomes as O
from webloom.streaming import scheduler as S
from webloom.tables import table

STATUSES = (200, 200, 301, 404, 429, 503, 500, 200)


def _fetched(s, d):
    status = F.element_at(F.array(*map(F.lit, STATUSES)), (F.col("id") % 8 + 1).cast("int"))
    f = view(s, d, "frontier").select(
        "id", "url", "host_id", F.when(F.col("id") % 17 > 0, status).alias("status"), "attempts", (F.col("id") % 6 == 0).alias("same"), (F.col("id") % 13 > 0).alias("html"),
        F.when(F.col("id") % 3 == 0, (F.col("id") % 90).cast("string")).alias("retry_after"), (F.col("id") % 2 == 0).alias("was_indexed"), (F.col("id") % 9 * 500).alias("delay_ms"),
    )
    return f.withColumn("outcome", O.outcome(F.col("status"), F.col("same"), F.col("html"), F.col("attempts")))


FETCHED_SQL = """WITH f AS (SELECT id, url, attempts, CASE WHEN id % 17 > 0 THEN [200, 200, 301, 404, 429, 503, 500, 200][id % 8 + 1] END AS status, id % 6 = 0 AS same, id % 13 > 0 AS html,
CASE WHEN id % 3 = 0 THEN id % 90 END AS ra, id % 2 = 0 AS was_indexed, id % 9 * 500 AS delay_ms FROM frontier),
o AS (SELECT *, CASE WHEN status IS NULL OR status = 500 THEN (CASE WHEN attempts >= 3 THEN 'gone' ELSE 'retry' END) WHEN status = 429 THEN 'throttled' WHEN status = 503 THEN 'unavailable' WHEN status = 301 THEN 'redirected'
WHEN status = 200 AND NOT html THEN 'gone' WHEN status = 200 AND same THEN 'unchanged' WHEN status = 200 THEN 'stored' ELSE 'gone' END AS outcome FROM f),
w AS (SELECT *, CASE WHEN outcome = 'throttled' THEN coalesce(ra, 60) ELSE least(greatest(coalesce(ra, 60), 1), 3600) END AS wait FROM o)"""


def _effects(s, d):
    e = O.apply_outcomes(_fetched(s, d), NOW, 30)
    return e.select("id", "outcome", "state", F.coalesce("next_attempt_at", F.lit(-1)).alias("next_attempt_at"), "attempts", "doc_action", "delay_ms", "host_gate")


def _stream(s, d):
    pages = S.read_stream(s, f"{d}/pages.parquet")
    return S.run_once(S.claim_stream(pages.select(host_of(F.col("url")).alias("host"), "url", F.lit(10**9).cast("bigint").alias("at")), 2), "claims")


def _stream_counts(s, d):
    events = S.read_stream(s, f"{d}/events.parquet")
    return S.run_once(S.windowed_counts(events).drop("value"), "windows").select(F.date_format("begin", "yyyy-MM-dd").alias("day"), "event_type", "n")


#: A window is put out once the watermark, an hour behind the latest event, is past its end.
WINDOWS_SQL = """WITH m AS (SELECT max(ts) - INTERVAL 1 HOUR AS mark FROM events)
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events, m WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= mark GROUP BY ALL"""

STATE = {
    "outcome_machine": (
        _effects,
        sql(f"""{FETCHED_SQL} SELECT id, outcome, CASE WHEN outcome IN ('stored', 'unchanged', 'retry', 'throttled', 'unavailable') THEN 0 WHEN outcome = 'redirected' THEN 2 ELSE 3 END AS state,
        CASE WHEN outcome IN ('stored', 'unchanged') THEN {NOW} + 30 * 86400 WHEN outcome = 'retry' THEN CAST({NOW} + 60 * power(4, least(greatest(attempts, 1), 4) - 1) AS BIGINT) WHEN outcome IN ('throttled', 'unavailable') THEN {NOW} + wait ELSE -1 END AS next_attempt_at,
        CASE WHEN outcome IN ('stored', 'unchanged') THEN 0 WHEN outcome IN ('throttled', 'unavailable') THEN greatest(attempts - 1, 0) ELSE attempts END AS attempts,
        CASE WHEN outcome = 'stored' THEN 'store' WHEN outcome = 'unchanged' THEN 'touch' WHEN outcome = 'gone' AND was_indexed THEN 'remove' ELSE 'none' END AS doc_action,
        CASE WHEN outcome = 'throttled' THEN least(2 * greatest(delay_ms, 1000), 600000) ELSE delay_ms END AS delay_ms,
        CASE WHEN outcome IN ('throttled', 'unavailable') THEN {NOW} + wait ELSE CAST({NOW} + ceil(greatest(delay_ms, 1000) / 1000.0) AS BIGINT) END AS host_gate FROM w"""),
    ),
    "outcome_counters": (lambda s, d: O.counters(_fetched(s, d)), sql(f"{FETCHED_SQL} SELECT outcome, count(*) AS n FROM o GROUP BY outcome")),
    "dead_page_removal": (
        lambda s, d: O.remove_dead(view(s, d, "docs"), O.apply_outcomes(_fetched(s, d), NOW, 30)).select("id", "url"),
        sql(f"{FETCHED_SQL} SELECT id, url FROM docs WHERE url NOT IN (SELECT url FROM o WHERE outcome = 'gone' AND was_indexed)"),
    ),
    "robots_turn": (
        lambda s, d: O.robots_turn(view(s, d, "frontier").select("host_id", F.when(F.col("id") % 4 > 0, 200 * (F.col("id") % 4)).alias("status"), F.lit("User-agent: *").alias("body"), "attempts"), NOW).groupBy("result", "gate", "attempts", F.coalesce("body", F.lit("-")).alias("body")).agg(F.count("*").alias("n")),
        sql(f"""WITH r AS (SELECT id % 4 AS k, greatest(attempts - 1, 0) AS attempts FROM frontier)
        SELECT CASE k WHEN 1 THEN 'cached' WHEN 2 THEN 'allow_all' ELSE 'unavailable' END AS result, CAST(CASE WHEN k IN (0, 3) THEN {NOW + 3600} ELSE {NOW} END AS BIGINT) AS gate, attempts, CASE k WHEN 1 THEN 'User-agent: *' ELSE '-' END AS body, count(*) AS n FROM r GROUP BY ALL"""),
    ),
    "robots_allowed": (
        lambda s, d: table(s, d, "pages").select("page_id", robots.allowed(F.lit("User-agent: webloom\nDisallow: /\nAllow: /en/\nDisallow: /*9$\n"), F.regexp_extract("url", "^https?://[^/]+(/[^?#]*)", 1), "webloom").alias("ok")),
        "SELECT page_id, path LIKE '/en/%' AS ok FROM (SELECT page_id, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS path FROM pages)",
    ),
    "late_peers": (lambda s, d: O.arrived_in_time(view(s, d, "corpus").select("id", (F.col("id") * 37 % 3000).alias("arrived_ms")), 1500), sql("SELECT id, id * 37 % 3000 AS arrived_ms FROM corpus WHERE id * 37 % 3000 <= 1500")),
    "reconcile": (
        lambda s, d: S.reconcile(view(s, d, "docs"), view(s, d, "docs").filter("indexed = 1")).select("id", "url"),
        sql("SELECT id, url FROM docs WHERE indexed = 0 ORDER BY shard_id, off LIMIT 200"),
    ),
    "drain_detection": (lambda s, d: S.is_drained(C.pending_soon(view(s, d, "frontier"), view(s, d, "hosts"), NOW, 3600)), sql(f"SELECT count(*) = 0 AS drained FROM frontier f JOIN hosts h ON h.id = f.host_id WHERE h.state = 1 AND (f.state = 1 OR (f.state = 0 AND f.next_attempt_at <= {NOW + 3600}))")),
    "stream_claims": (
        _stream,
        "SELECT host, url, 1000000000 + 2 * (row_number() OVER (PARTITION BY host ORDER BY url) - 1) AS claimed_at FROM (SELECT DISTINCT regexp_extract(lower(url), '^https?://([^/:?#]+)', 1) AS host, url FROM pages)",
    ),
    "stream_windows": (_stream_counts, WINDOWS_SQL),
    "event_windows": (
        lambda s, d: S.windowed_counts(table(s, d, "events")).select(F.date_format("begin", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("value", 4).alias("value")),
        "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL",
    ),
    "event_sessions": (
        lambda s, d: S.sessions(table(s, d, "events")).groupBy("user_id").agg(F.count("*").alias("sessions"), F.sum("n").alias("events")),
        """WITH g AS (SELECT user_id, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS begins FROM events)
        SELECT user_id, CAST(sum(begins) AS BIGINT) AS sessions, count(*) AS events FROM g GROUP BY user_id""",
    ),
}
