"""Packing documents into token sequences: hierarchical residual best fit.

Round 0 packs each partition of the scan by itself, best fit over decreasing sizes. Bins filled to CLOSE_AT of the
capacity are final. The others go on as items of their fill, with their members, to the next round, where the bins of
FAN_IN neighbouring partitions are packed together; and so on up the tree to its root, where what is left is final. A
group of more than MAX_GROUP bins is dealt by hash into slices of about that many, which have the same mix of fills and
are packed side by side; at the root as well, so that bins of all partitions meet whatever their number. Only underfull
bins are ever shuffled, and they hold ids and counts, not texts. Each round is written to the shared folder.

A document longer than the capacity fills bins of its own with its full pieces; the rest of it is an item. Every token
of every text is in exactly one bin. A text without tokens (null, empty, white space) is in none. Equal or repeated
rows are separate items; equal fills are taken in order of place. Other columns, whatever their names, are ignored. An
empty table gives an empty result.

Tokens are runs of characters other than white space unless a column of counts is named.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.session import materialize
from webloom.tables import table

from ._cols import pick

CAPACITY = 2048
CLOSE_AT = 0.98
FAN_IN = 16
MAX_GROUP = 1_000_000

MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("n_tokens", pa.int32())])
BINS = pa.schema([("round", pa.int32()), ("part", pa.int64()), ("seq", pa.int32()), ("fill", pa.int32()), ("closed", pa.bool_()), ("members", pa.list_(MEMBER))])
DDL = "round int, part bigint, seq int, fill int, closed boolean, members array<struct<doc_id:bigint,piece:int,start:bigint,n_tokens:int>>"


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Bin of each item, in the order given: the open bin with the least room that suffices, else a new one."""
    out = np.empty(len(sizes), np.int64)
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    there = 0  # bit r: some bin has room r
    bins = 0
    for i, s in enumerate(sizes.tolist()):
        fits = there >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            held = rooms[room]
            b = held.pop()
            if not held:
                there ^= 1 << room
        else:
            b, room = bins, capacity
            bins += 1
        out[i] = b
        room -= s
        if room:
            rooms[room].append(b)
            there |= 1 << room
    return out


def pack(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(items by bin, offsets by bin, fills) of best fit over decreasing sizes; equal sizes keep their order."""
    order = np.argsort(-sizes, kind="stable")
    where = best_fit(sizes[order], capacity)
    by_bin = np.argsort(where, kind="stable")
    fills = np.bincount(where, sizes[order]).astype(np.int64)
    offsets = np.concatenate(([0], np.cumsum(np.bincount(where, minlength=len(fills)))))
    return order[by_bin], offsets, fills


def _bins(round_: int, part: int, first: int, fills: np.ndarray, closed: np.ndarray, members: pa.ListArray) -> pa.RecordBatch:
    n = len(fills)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(n, round_, np.int32)), pa.array(np.full(n, part, np.int64)), pa.array(np.arange(first, first + n, dtype=np.int32)), pa.array(fills.astype(np.int32)), pa.array(closed), members],
        schema=BINS,
    )


def _local(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        rows = pa.Table.from_batches(got)
        rows = rows.take(pa.compute.sort_indices(rows, [("doc_id", "ascending"), ("n", "ascending")]))
        ids, n = rows.column("doc_id").combine_chunks(), rows.column("n").to_numpy().astype(np.int64)
        part = TaskContext.get().partitionId()
        full, rest = n // capacity, n % capacity
        # full pieces are bins of their own
        owner = np.repeat(np.arange(len(n)), full)
        piece = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)
        if len(owner):
            alone = pa.StructArray.from_arrays([ids.take(pa.array(owner)), pa.array(piece.astype(np.int32)), pa.array(piece * capacity), pa.array(np.full(len(owner), capacity, np.int32))], fields=list(MEMBER))
            yield _bins(0, part, 0, np.full(len(owner), capacity), np.ones(len(owner), bool), pa.ListArray.from_arrays(pa.array(np.arange(len(owner) + 1, dtype=np.int32)), alone))
        items = np.flatnonzero(rest)
        if len(items):
            order, offsets, fills = pack(rest[items], capacity)
            chosen = items[order]
            held = pa.StructArray.from_arrays([ids.take(pa.array(chosen)), pa.array(full[chosen].astype(np.int32)), pa.array(full[chosen] * capacity), pa.array(rest[chosen].astype(np.int32))], fields=list(MEMBER))
            yield _bins(0, part, len(owner), fills, fills >= CLOSE_AT * capacity, pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), held))

    return run


def _merge(round_: int, capacity: int, last: bool):
    def run(got: pa.Table) -> pa.Table:
        got = got.take(pa.compute.sort_indices(got, [("part", "ascending"), ("seq", "ascending")]))
        group = got.column("group")[0].as_py()
        order, offsets, fills = pack(got.column("fill").to_numpy().astype(np.int64), capacity)
        members = got.column("members").combine_chunks().take(pa.array(order))
        ends = np.concatenate(([0], np.cumsum(members.value_lengths().to_numpy())))[offsets]
        closed = np.ones(len(fills), bool) if last else fills >= CLOSE_AT * capacity
        return pa.Table.from_batches([_bins(round_, group, 0, fills, closed, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), members.flatten()))])

    return run


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, tokens: str | None = None, max_group: int = MAX_GROUP) -> DataFrame:
    """(bin_id, n_tokens, members) of each bin; members in order, each (doc_id, piece, start, n_tokens)."""
    if tokens:
        items = pick(docs, doc_id="bigint", **{tokens: "bigint"}).withColumnRenamed(tokens, "n")
    else:
        items = pick(docs, doc_id="bigint", text="string").select("doc_id", F.regexp_count("text", F.lit(r"\S+")).cast("bigint").alias("n"))
    bins = materialize(items.filter("n > 0").mapInArrow(_local(capacity), DDL), "pack0")
    done, round_, width = bins.filter("closed"), 0, 1  # width: part numbers of a group
    left = bins.filter("NOT closed")
    while True:
        parts = left.agg(F.coalesce(F.floor(F.max("part") / width), F.lit(-1)) + 1).first()[0]
        if not parts or (round_ and parts <= 1):
            break
        last, round_ = parts <= FAN_IN, round_ + 1
        grouped = left.withColumn("group", F.floor(F.col("part") / (FAN_IN * width)).cast("bigint"))
        most = grouped.groupBy("group").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
        width = -(-most // max_group)
        dealt = grouped.withColumn("group", F.col("group") * width + F.pmod(F.xxhash64("part", "seq"), F.lit(width)))
        bins = materialize(dealt.groupBy("group").applyInArrow(_merge(round_, capacity, last), DDL), f"pack{round_}")
        done = done.unionByName(bins.filter("closed"))
        left = bins.filter("NOT closed")
    key = F.shiftleft(F.col("round").cast("bigint"), 58) + F.shiftleft(F.col("part"), 31) + F.col("seq")
    return done.unionByName(left).select(key.alias("bin_id"), F.col("fill").alias("n_tokens"), "members")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
