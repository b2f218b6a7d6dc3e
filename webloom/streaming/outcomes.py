"""The outcome machine: what a fetch does to its frontier row, document and host, as pure expressions.

fetched: (id, url, host_id, outcome, status, attempts, sha256, prior_sha, truncated, retry_after, was_indexed), where
outcome is stored, unchanged, redirected, retry, throttled, unavailable or gone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webloom.functions.times import retry_at, sticky_delay, unavailable_wait

MAX_ATTEMPTS = 3
QUEUED, DONE, FAILED = 0, 2, 3
DAY = 86_400
ROBOTS_STALL = 3600
REDIRECTS = (301, 302, 303, 307, 308)


def outcome(status: Column, same: Column, allowed_type: Column, attempts: Column) -> Column:
    """Of a response; a null status is a network failure."""
    again = F.when(attempts >= MAX_ATTEMPTS, "gone").otherwise("retry")
    return (
        F.when(status.isNull(), again)
        .when(status == 429, "throttled")
        .when(status == 503, "unavailable")
        .when(status >= 500, again)
        .when(status.isin(*REDIRECTS), "redirected")
        .when(status.between(200, 299) & ~allowed_type, "gone")
        .when(status.between(200, 299) & same, "unchanged")
        .when(status.between(200, 299), "stored")
        .otherwise("gone")
    )


def is_unchanged(sha: Column, prior: Column, truncated: Column) -> Column:
    return sha.eqNullSafe(prior) & sha.isNotNull() & ~truncated


def apply_outcomes(fetched: DataFrame, now: int, recrawl_days: int, floor_ms: int = 1000, cap_ms: int = 600_000) -> DataFrame:
    """Each row with its next state: frontier (state, next_attempt_at, attempts), document action, host delay and gate."""
    o, n = F.col("outcome"), F.lit(now).cast("bigint")
    ok = o.isin("stored", "unchanged")
    wait = F.when(o == "throttled", F.coalesce(F.col("retry_after").try_cast("bigint"), F.lit(60).cast("bigint"))).otherwise(unavailable_wait(F.col("retry_after")))
    given_back = F.greatest(F.col("attempts") - 1, F.lit(0))
    return fetched.select(
        "id", "url", "host_id", "outcome",
        F.when(ok | o.isin("retry", "throttled", "unavailable"), QUEUED).when(o == "redirected", DONE).otherwise(FAILED).alias("state"),
        F.when(ok, n + recrawl_days * DAY).when(o == "retry", retry_at(n, F.col("attempts"))).when(o.isin("throttled", "unavailable"), n + wait).alias("next_attempt_at"),
        F.when(ok, 0).when(o.isin("throttled", "unavailable"), given_back).otherwise(F.col("attempts")).alias("attempts"),
        F.when(o == "stored", "store").when(o == "unchanged", "touch").when((o == "gone") & F.col("was_indexed"), "remove").otherwise("none").alias("doc_action"),
        F.when(o == "throttled", sticky_delay(F.col("delay_ms"), F.lit(floor_ms), F.lit(cap_ms))).otherwise(F.col("delay_ms")).alias("delay_ms"),
        F.when(o.isin("throttled", "unavailable"), n + wait).otherwise(n + F.ceil(F.greatest(F.col("delay_ms"), F.lit(floor_ms)) / 1000)).alias("host_gate"),
    )


def robots_turn(turns: DataFrame, now: int) -> DataFrame:
    """(host_id, result, body, gate, attempts): a robots fetch gives the attempt back; an unavailable one stalls the host."""
    from webloom.sources.robots import outcome as robots_outcome

    result = robots_outcome(F.col("status"))
    return turns.select(
        "host_id", result.alias("result"), F.when(result == "cached", F.substring("body", 1, 512 * 1024)).alias("body"),
        F.when(result == "unavailable", F.lit(now + ROBOTS_STALL)).otherwise(F.lit(now)).cast("bigint").alias("gate"), F.greatest(F.col("attempts") - 1, F.lit(0)).alias("attempts"),
    )


def remove_dead(index: DataFrame, effects: DataFrame) -> DataFrame:
    """The index without pages that failed for good."""
    return index.join(effects.filter("doc_action = 'remove'").select("url"), "url", "left_anti")


def counters(effects: DataFrame) -> DataFrame:
    return effects.groupBy("outcome").agg(F.count("*").alias("n"))


def arrived_in_time(hits: DataFrame, deadline_ms: int) -> DataFrame:
    """Peers' answers by the deadline; the others count for nothing."""
    return hits.filter(F.col("arrived_ms") <= deadline_ms)
