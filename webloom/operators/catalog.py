"""Catalog operators: filters, joins, aggregates, windows and merges over hosts, frontier, docs, links and shards.

Snapshots are DataFrames; an update is a new one. Every function declares a plan and starts no job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACTIVE, QUEUED, CLAIMED, DONE, SEALED = 1, 0, 1, 2, 1
LEASE_SECONDS = 900
GATE_REASONS = ("noindex", "empty", "lang")


# Filters.
def ready_hosts(hosts: DataFrame, now: int) -> DataFrame:
    return hosts.filter((F.col("state") == ACTIVE) & ~F.col("in_flight") & (F.col("next_fetch_at") <= now))


def due_urls(frontier: DataFrame, now: int) -> DataFrame:
    return frontier.filter((F.col("state") == QUEUED) & (F.col("next_attempt_at") <= now))


def is_ingestible(kind: Column, url: Column, status: Column, content_type: Column) -> Column:
    """A successful response for a usable URL that is HTML, or doesn't say what it is."""
    return (kind == "response") & url.isNotNull() & status.between(200, 299) & is_html(content_type)


def is_html(content_type: Column) -> Column:
    bare = F.trim(F.lower(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    return (bare == "") | bare.isin("text/html", "application/xhtml+xml")


def gate(noindex: Column, text: Column, lang: Column, languages: list[str]) -> Column:
    """Why a page isn't indexed, the first reason that holds; 'pending' if none."""
    verdict = F.when(noindex, "noindex").when(text.isNull(), "empty")
    if languages:
        verdict = verdict.when(lang.isNull() | ~lang.isin(*languages), "lang")
    return verdict.otherwise("pending")


def pending(docs: DataFrame) -> DataFrame:
    return docs.filter("indexed = 0")


def rebuildable(docs: DataFrame) -> DataFrame:
    """All but the rows that failed; three-valued, so a null reason keeps a row that isn't skipped."""
    return docs.filter("NOT (indexed = 2 AND skip_reason = 'error')")


def named_like(df: DataFrame, column: str, prefix: str) -> DataFrame:
    return df.filter(F.startswith(F.col(column), F.lit(prefix)))


def unfinished_shards(shards: DataFrame, me: str) -> DataFrame:
    return shards.filter(F.col("ingested_at").isNull() & (F.col("state") == SEALED) & (F.col("origin") != me))


def offered_shards(shards: DataFrame, me: str) -> DataFrame:
    """What a peer may fetch from us."""
    return shards.filter((F.col("state") == SEALED) & (F.col("origin") == me) & F.col("hash").isNotNull())


def credible(shards: DataFrame, peer: str) -> DataFrame:
    """Offers of a peer's own shards with a whole hash and a size."""
    return shards.filter((F.col("origin") == peer) & (F.length("hash") == 64) & (F.col("bytes") > 0))


# Joins.
def claim(hosts: DataFrame, frontier: DataFrame, docs: DataFrame, now: int, batch: int) -> DataFrame:
    """The next jobs: the first due URL of each ready host, those of the longest waiting hosts, with the last sha."""
    w = Window.partitionBy("host_id").orderBy("next_attempt_at", "id")
    first = due_urls(frontier, now).withColumn("n", F.row_number().over(w)).filter("n = 1")
    ready = ready_hosts(hosts, now).select(F.col("id").alias("host_id"), "host", "next_fetch_at")
    jobs = ready.join(first.select("host_id", F.col("id").alias("frontier_id"), "url", "attempts", "depth"), "host_id")
    jobs = jobs.orderBy("next_fetch_at", "host_id").limit(batch)
    return jobs.join(docs.select("url", F.col("sha256").alias("prior_sha")), "url", "left")


def with_hosts_and_shards(docs: DataFrame, hosts: DataFrame, shards: DataFrame) -> DataFrame:
    h = hosts.select(F.col("id").alias("host_id"), "host", "centrality")
    s = shards.select(F.col("id").alias("shard_id"), F.col("name").alias("shard"))
    return docs.join(s, "shard_id").join(h, "host_id")


def pending_soon(frontier: DataFrame, hosts: DataFrame, now: int, horizon: int) -> DataFrame:
    """How many URLs of active hosts are in flight or due within the horizon."""
    soon = frontier.filter((F.col("state") == CLAIMED) | ((F.col("state") == QUEUED) & (F.col("next_attempt_at") <= now + horizon)))
    return soon.join(hosts.filter(F.col("state") == ACTIVE).select(F.col("id").alias("host_id")), "host_id", "left_semi").agg(F.count("*").alias("n"))


def stuck_hosts(hosts: DataFrame, frontier: DataFrame) -> DataFrame:
    """In flight without a claimed URL."""
    claimed = frontier.filter(F.col("state") == CLAIMED).select(F.col("host_id").alias("id"))
    return hosts.filter("in_flight").join(claimed, "id", "left_anti")


def unknown_shards(offers: DataFrame, known: DataFrame) -> DataFrame:
    return offers.join(known.select("hash"), "hash", "left_anti")


def without_ids(docs: DataFrame, busy: DataFrame) -> DataFrame:
    return docs.join(busy.select("id"), "id", "left_anti")


def indexed_copies(docs: DataFrame) -> DataFrame:
    """Documents whose bytes another URL has in the index already."""
    there = docs.filter("indexed = 1").select("sha256", F.col("url").alias("other"))
    few = there.groupBy("sha256").agg(F.min("other").alias("lo"), F.max("other").alias("hi"))
    return docs.join(few, "sha256").filter("url <> lo OR url <> hi").drop("lo", "hi")


def changed(frontier: DataFrame, docs: DataFrame, fetched: DataFrame) -> DataFrame:
    """(url, changed): whether the fetched bytes differ from those stored under the frontier's URL."""
    prior = frontier.select("url").join(docs.select("url", F.col("sha256").alias("prior_sha")), "url", "left")
    return fetched.select("url", "sha256").join(prior, "url").select("url", (~F.col("prior_sha").eqNullSafe(F.col("sha256"))).alias("changed"))


# Aggregates.
def gauges(hosts: DataFrame, frontier: DataFrame, docs: DataFrame, shards: DataFrame) -> DataFrame:
    """One row of counts by state: one pass for each table."""
    h = hosts.agg(F.count_if(F.col("state") == ACTIVE).alias("hosts_active"), F.count_if("in_flight").alias("hosts_in_flight"))
    f = frontier.agg(F.count_if(F.col("state") == QUEUED).alias("urls_queued"), F.count_if(F.col("state") == CLAIMED).alias("urls_claimed"))
    d = docs.agg(*[F.count_if(F.col("indexed") == i).alias(n) for i, n in enumerate(("docs_pending", "docs_indexed", "docs_skipped"))], F.count("*").alias("docs"))
    s = shards.agg(F.count_if(F.col("state") == SEALED).alias("shards_sealed"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("shard_bytes"))
    return h.crossJoin(f).crossJoin(d).crossJoin(s)


def foreign_bytes(shards: DataFrame, me: str) -> DataFrame:
    return shards.filter(F.col("origin") != me).agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("used"))


def skip_histogram(docs: DataFrame) -> DataFrame:
    return docs.filter("indexed = 2").groupBy("skip_reason").agg(F.count("*").alias("n"))


def edge_weights(page_links: DataFrame) -> DataFrame:
    """(from_host, to_host, cnt): distinct targets of each accepted page, without links within a host."""
    return page_links.filter("from_host <> to_host").groupBy("from_host", "to_host").agg(F.count("*").alias("cnt"))


def add_edges(links: DataFrame, more: DataFrame) -> DataFrame:
    return links.unionByName(more).groupBy("from_host", "to_host").agg(F.sum("cnt").alias("cnt"))


def next_sequence(shards: DataFrame, prefix: str) -> DataFrame:
    """One more than the last number among the names that begin so."""
    number = F.regexp_extract("name", r"-(\d+)$", 1).try_cast("bigint")
    return named_like(shards, "name", prefix).agg((F.coalesce(F.max(number), F.lit(-1)) + 1).alias("next"))


# Windows.
def top_per_host(frontier: DataFrame, now: int) -> DataFrame:
    w = Window.partitionBy("host_id").orderBy("next_attempt_at", "id")
    return due_urls(frontier, now).withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def interleave(lists: DataFrame, limit: int) -> DataFrame:
    """Round robin over lists (list_idx, pos), each URL once, at its first place."""
    turn = Window.partitionBy("list_idx").orderBy("pos")
    same = Window.partitionBy("url").orderBy("turn", "list_idx")
    ranked = lists.withColumn("turn", F.row_number().over(turn))
    return ranked.withColumn("seen", F.row_number().over(same)).filter("seen = 1").drop("seen").orderBy("turn", "list_idx").limit(limit)


def within_quota(offers: DataFrame, used: int, quota: int) -> DataFrame:
    """Oldest first until the first that would exceed the quota; those after it wait as well."""
    w = Window.partitionBy("origin").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return offers.withColumn("total", F.sum("bytes").over(w) + used).filter(F.col("total") <= quota)


def admit(found: DataFrame, hosts: DataFrame, frontier: DataFrame, cap: int, max_depth: int) -> DataFrame:
    """New URLs of active hosts, in arrival order, while the host is under its cap."""
    fresh = found.filter(F.col("depth") <= max_depth).withColumn("n", F.row_number().over(Window.partitionBy("url").orderBy("arrival"))).filter("n = 1").drop("n")
    fresh = fresh.join(frontier.select("url"), "url", "left_anti")
    active = hosts.filter(F.col("state") == ACTIVE).select(F.col("id").alias("host_id"), "urls_accepted")
    w = Window.partitionBy("host_id").orderBy("arrival", "url")
    return fresh.join(active, "host_id").withColumn("n", F.row_number().over(w)).filter(F.col("n") <= F.lit(cap) - F.col("urls_accepted")).drop("n", "urls_accepted")


def accepted_at_arrival(snapshots: DataFrame) -> DataFrame:
    """Snapshots (url, arrival, fetched_at, sha256) that weren't older than all before them, nor a repeat of the current
    one: at equal time a record is accepted only if its bytes differ from those then current."""
    before = Window.partitionBy("url").orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1)
    newest = snapshots.withColumn("best", F.max("fetched_at").over(before)).filter("best IS NULL OR fetched_at >= best")
    step = Window.partitionBy("url").orderBy("arrival")
    prior = newest.withColumns({"last_at": F.lag("fetched_at").over(step), "last_sha": F.lag("sha256").over(step)})
    return prior.filter("last_at IS NULL OR NOT (last_at = fetched_at AND last_sha = sha256)").drop("best", "last_at", "last_sha")


def newest_snapshot(snapshots: DataFrame) -> DataFrame:
    """The row of each URL that stands in the end: the last that was accepted."""
    w = Window.partitionBy("url").orderBy(F.desc("arrival"))
    return accepted_at_arrival(snapshots).withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n")


def expired_leases(frontier: DataFrame, now: int) -> DataFrame:
    return frontier.filter((F.col("state") == CLAIMED) & (F.col("claimed_at") < now - LEASE_SECONDS))


def recover(frontier: DataFrame) -> DataFrame:
    """After a restart: claimed URLs are queued again and their attempt is given back."""
    claimed = F.col("state") == CLAIMED
    return frontier.withColumns({"attempts": F.when(claimed, F.greatest(F.col("attempts") - 1, F.lit(0))).otherwise(F.col("attempts")), "state": F.when(claimed, QUEUED).otherwise(F.col("state"))})


def rotate(records: DataFrame, cap: int) -> DataFrame:
    """(id, shard): each shard rolls after the batch in which it reaches the cap with more than one record.

    Records are (writer, batch, id, bytes); a writer's are folded in order, as a roll depends on all before it."""

    def fold(key, pdf):
        pdf = pdf.sort_values(["batch", "id"])
        shard = size = count = 0
        out = []
        for _, part in pdf.groupby("batch", sort=False):
            out += [shard] * len(part)
            size, count = size + int(part["bytes"].sum()), count + len(part)
            if size >= cap and count > 1:
                shard, size, count = shard + 1, 0, 0
        return pdf.assign(shard=out)[["writer", "id", "shard"]]

    return records.groupBy("writer").applyInPandas(fold, "writer bigint, id bigint, shard bigint")


# Merges.
def insert_or_ignore(base: DataFrame, more: DataFrame, key: str, order: str) -> DataFrame:
    """base, and of each new key the first of more."""
    w = Window.partitionBy(key).orderBy(order)
    new = more.withColumn("n", F.row_number().over(w)).filter("n = 1").drop("n").join(base.select(key), key, "left_anti")
    return base.unionByName(new.select(*base.columns))


def upsert(base: DataFrame, more: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Full outer merge: the columns named come from more where it has the key."""
    b, m = base.alias("b"), more.alias("m")
    there = F.col(f"m.{key}").isNotNull()
    out = [F.coalesce(f"m.{key}", f"b.{key}").alias(key)]
    for c in base.columns:
        if c != key:
            both = F.when(there, F.col(f"m.{c}")).otherwise(F.col(f"b.{c}")) if c in columns else F.coalesce(f"b.{c}", f"m.{c}")
            out.append(both.alias(c))
    return b.join(m, F.col(f"b.{key}") == F.col(f"m.{key}"), "full").select(*out).select(*base.columns)


def mark(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """docs with the states (id, indexed, skip_reason) of marks."""
    m = marks.select("id", F.col("indexed").alias("new_state"), F.col("skip_reason").alias("new_reason"))
    j = docs.join(m, "id", "left")
    reason = F.when(F.col("new_state").isNotNull(), F.col("new_reason")).otherwise(F.col("skip_reason"))
    return j.withColumns({"skip_reason": reason, "indexed": F.coalesce("new_state", "indexed")}).drop("new_state", "new_reason")


def replace_by_key(index: DataFrame, more: DataFrame, key: str = "url") -> DataFrame:
    """Delete-before-add: the rows of more take the place of those with their keys."""
    return index.join(more.select(key), key, "left_anti").select(*index.columns).unionByName(more.select(*index.columns))
