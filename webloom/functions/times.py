"""Times, politeness and retry arithmetic: all built-in Column expressions on integers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ROBOTS_DELAY_CAP_MS = 30_000


def iso8601(seconds: Column) -> Column:
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def parse_iso8601(text: Column) -> Column:
    """Unix seconds of a strict UTC time, null otherwise; fractions are dropped and second 60 reads as 59."""
    strict = F.regexp_like(text, F.lit(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?Z$"))
    whole = F.regexp_replace(F.substring(text, 1, 19), ":60$", ":59")
    return F.when(strict, F.unix_seconds(F.try_to_timestamp(whole, F.lit("yyyy-MM-dd'T'HH:mm:ss"))))


def gate_at(now_ms: Column, delay_ms: Column) -> Column:
    """The second from which a host may be asked again: rounded up."""
    return F.expr("0") + F.floor((now_ms + F.greatest(delay_ms, F.lit(0)) + 999) / 1000).cast("bigint")


def retry_at(now: Column, attempt: Column) -> Column:
    n = F.least(F.greatest(attempt, F.lit(1)), F.lit(4))
    return now + (F.lit(60) * F.pow(F.lit(4), n - 1)).cast("bigint")


def effective_delay(floor_ms: Column, robots_ms: Column, host_ms: Column) -> Column:
    return F.greatest(floor_ms, F.least(robots_ms, F.lit(ROBOTS_DELAY_CAP_MS)), host_ms)


def sticky_delay(host_ms: Column, floor_ms: Column, cap_ms: Column) -> Column:
    """After a 429: doubled, up to the cap."""
    return F.least(F.lit(2) * F.greatest(host_ms, floor_ms), cap_ms)


def retry_after(header: Column) -> Column:
    """Whole seconds; dates and anything else are null."""
    return F.when(F.regexp_like(F.trim(header), F.lit(r"^\d{1,9}$")), F.trim(header).try_cast("bigint"))


def unavailable_wait(header: Column) -> Column:
    """After a 503: the header's seconds or 60, from 1 to 3600."""
    return F.least(F.greatest(F.coalesce(retry_after(header), F.lit(60)), F.lit(1)), F.lit(3600))


def clamp_rank(rank10: Column) -> Column:
    return F.least(F.greatest(F.coalesce(rank10.try_cast("double"), F.lit(0.0)) / 10, F.lit(0.0)), F.lit(1.0))
