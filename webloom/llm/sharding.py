"""Sharding by vector bin packing over bytes, tokens and rows.

There are ceil(bytes / SHARD_BYTES) shards, at least LEAST_SHARDS (a reader each), with an equal share of all three totals
as their capacity. Groups are the rows of one source in one hash slot; a source has as many slots as its bytes need for
groups of about a GROUPS_PER_SHARDth of a shard, so that a hot source spreads. Groups are placed in decreasing order of
their largest share; each goes, of the shards with room for it in every dimension, to the one whose residual capacity has
the highest dot product with the group's vector, ties to the lowest number; where none has room, to the highest dot
product of all.

Placement runs in cells of up to CELL_SHARDS shards (as equal in number as can be), each in a task of its own. Where there are several cells, groups are
dealt to them in decreasing order of their largest share, to and fro, by ranks from range partitions; with some thousand
small groups a cell, cells get equal shares. So no task sees all groups. Rows carry ids and counts only; texts are read
once and never shuffled.

Nulls: a null source is a source of its own; a null text has 0 bytes and tokens and counts as a row. A text larger than a
shard is a group that overfills one. Equal rows are in the same group, and equal groups go by source and slot. Every row
gets a shard, in an order-independent way. Other columns, whatever their names, are ignored. An empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.session import materialize
from webloom.tables import table

from ._cols import pick

SHARD_BYTES = 128 << 20
LEAST_SHARDS = 16
GROUPS_PER_SHARD = 16
CELL_SHARDS = 512
KEY = ["source", "slot"]


def place(vectors: np.ndarray, capacities: np.ndarray) -> np.ndarray:
    """Bin of each vector (n x 3), in the order given, for bins of the capacities (bins x 3)."""
    scale = np.maximum(capacities.max(0), 1)
    residual = capacities / scale
    out = np.empty(len(vectors), np.int64)
    for i, v in enumerate(vectors / scale):
        dot = residual @ v
        fits = (residual >= v - 1e-12).all(1)
        out[i] = np.where(fits, dot, -np.inf).argmax() if fits.any() else dot.argmax()
        residual[out[i]] -= v
    return out


def _in_cell(shards: int, cells: int):
    def run(t: pa.Table) -> pa.Table:
        v = np.stack([t.column(c).to_numpy().astype(float) for c in ("bytes", "tokens", "n_rows")], 1)
        share = (v / np.maximum(v.sum(0), 1)).max(1)
        order = pa.compute.sort_indices(t.append_column("share", pa.array(share)), [("share", "descending"), ("source", "ascending"), ("slot", "ascending")])
        t, v = t.take(order), v[order.to_numpy()]
        cell = t.column("cell")[0].as_py()
        first = cell * shards // cells
        n = (cell + 1) * shards // cells - first
        shard = first + place(v, np.tile(v.sum(0) / n, (n, 1)))
        return pa.table({"source": t.column("source"), "slot": t.column("slot"), "shard": pa.array(shard, pa.int64())})

    return run


def _dealt(groups: DataFrame, totals: tuple, cells: int) -> DataFrame:
    """The groups with their cells: by rank in decreasing order of their largest share, to and fro."""
    if cells == 1:
        return groups.withColumn("cell", F.lit(0).cast("bigint"))
    parts = max(1, int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    share = F.greatest(*[F.col(c) / F.lit(float(max(1, x))) for c, x in zip(("bytes", "tokens", "n_rows"), totals)])
    by = [F.desc("share"), F.asc("source"), F.asc("slot")]
    ranged = materialize(groups.withColumn("share", share).repartitionByRange(parts, *by).withColumn("range", F.spark_partition_id()), "ranged")
    sizes = ranged.groupBy("range").agg(F.count("*").alias("n"))
    before = sizes.select("range", F.coalesce(F.sum("n").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # a row for each range
    ranked = ranged.join(F.broadcast(before), "range").withColumn("k", F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy(*by)) - 1)
    turn = F.pmod("k", F.lit(2 * cells))
    return ranked.withColumn("cell", F.least(turn, 2 * cells - 1 - turn).cast("bigint")).select(*KEY, "bytes", "tokens", "n_rows", "cell")


def _slotted(docs: DataFrame, shard_bytes: int, least_shards: int) -> tuple[DataFrame, int]:
    """(doc_id, source, slot, bytes, tokens) of every row; and the number of shards."""
    rows = pick(docs, doc_id="bigint", source="string", text="string")
    sized = rows.select(
        "doc_id", "source", F.xxhash64("doc_id", "text").alias("h"),
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("bytes"),
        F.coalesce(F.regexp_count("text", F.lit(r"\S+")), F.lit(0)).cast("bigint").alias("tokens"),
    )
    sized = materialize(sized, "sized")
    whole = int(sized.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0])
    shards = max(1, least_shards, -(-whole // shard_bytes))
    group_bytes = max(1, min(shard_bytes, -(-whole // shards)) // GROUPS_PER_SHARD)
    slots = sized.groupBy(F.col("source").alias("of")).agg(F.greatest(F.lit(1), F.ceil(F.sum("bytes") / group_bytes)).alias("slots"))
    return sized.join(slots, F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "source", F.pmod("h", "slots").alias("slot"), "bytes", "tokens"), shards


def assign(docs: DataFrame, shard_bytes: int = SHARD_BYTES, least_shards: int = LEAST_SHARDS, cell_shards: int = CELL_SHARDS) -> DataFrame:
    """(doc_id, bytes, tokens, shard) of every row."""
    slotted, shards = _slotted(docs, shard_bytes, least_shards)
    groups = materialize(slotted.groupBy(*KEY).agg(F.sum("bytes").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("n_rows")), "sharded")
    totals = groups.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in ("bytes", "tokens", "n_rows")]).first()
    cells = -(-shards // cell_shards)
    placed = materialize(_dealt(groups, totals, cells).groupBy("cell").applyInArrow(_in_cell(shards, cells), "source string, slot bigint, shard bigint"), "placed")
    to = placed.select(F.col("source").alias("of_source"), F.col("slot").alias("of_slot"), "shard")
    return slotted.join(to, F.col("source").eqNullSafe(F.col("of_source")) & (F.col("slot") == F.col("of_slot"))).select("doc_id", "bytes", "tokens", "shard")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assign(table(spark, sf_dir, "documents"))
