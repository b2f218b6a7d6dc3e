"""Per-host scheduling as a stateful stream, the index's commit trigger, and windowed counts of events."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from webloom.session import new_table_path

OUT = "host string, url string, claimed_at bigint"
STATE = "seen array<bigint>, gate bigint"


def _key(url: str) -> int:
    return int.from_bytes(blake2b(url.encode(), digest_size=8).digest(), "big", signed=True)


def claim_stream(found: DataFrame, delay_s: int = 1) -> DataFrame:
    """Jobs from a stream of (host, url, at): each URL of a host once, with the second from which it may be fetched.

    A URL may go at the second of its arrival, but not before delay_s after the host's URL before it; those of a
    micro-batch go in order of (at, url). As a job carries its time, none waits in the state for another row of its host.
    State by host: hashes of the URLs given out, and the second from which the next may go."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        given, gate = state.get if state.exists else ([], None)
        seen = set(given)
        rows = sorted({(int(at), url) for b in batches for url, at in zip(b["url"], b["at"]) if url is not None})
        out: list[tuple[Any, ...]] = []
        for at, url in rows:
            if _key(url) not in seen:
                seen.add(_key(url))
                claimed = at if gate is None else max(gate, at)
                gate = claimed + delay_s
                out.append((key[0], url, claimed))
        if gate is not None:
            state.update((list(seen), gate))
        yield pd.DataFrame(out, columns=["host", "url", "claimed_at"])

    return found.groupBy("host").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def run_once(stream: DataFrame, tag: str) -> DataFrame:
    """Runs a stream over what is there now, into a table in the shared folder."""
    spark = stream.sparkSession
    path = new_table_path(spark, tag)
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start(path)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def read_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """A table's files as a stream. files_per_trigger bounds a micro-batch, and with it an index commit."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path + "*")


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(begin, event_type, n, value) of event-time windows; rows later than the watermark are dropped."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", late) if events.isStreaming else timed
    w = F.window("ts", window)
    return timed.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value")).select(F.col("w.start").alias("begin"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, begin, n): runs of a user's events without a longer gap."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    timed = timed.withWatermark("ts", "1 hour") if events.isStreaming else timed
    w = F.session_window("ts", gap)
    return timed.groupBy("user_id", w.alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("begin"), "n")


def commit_due(ops: int, seconds: float, commit_docs: int = 1000, commit_secs: float = 60) -> bool:
    return ops > 0 and (ops >= commit_docs or seconds >= commit_secs)


def reconcile(docs: DataFrame, index: DataFrame, batch: int = 200) -> DataFrame:
    """The next pending documents that the index lacks, oldest archive place first. Running it again changes nothing."""
    return docs.filter("indexed = 0").join(index.select("url"), "url", "left_anti").orderBy("shard_id", "off").limit(batch)


def is_drained(pending_soon: DataFrame) -> DataFrame:
    return pending_soon.select((F.col("n") == 0).alias("drained"))
