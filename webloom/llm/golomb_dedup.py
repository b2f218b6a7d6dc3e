"""Exact deduplication by an exchange of Golomb-coded fingerprints.

1. Every partition sorts the fingerprints of its texts and sends each owner (a range of the fingerprint space) its
   share as one Golomb-Rice coded blob.
2. There are as many owners as shuffle partitions, and more where an owner would get over OWNER_ROWS rows. An owner decodes its blobs and answers each partition with a bitmap over the partition's sorted fingerprints: set
   where the fingerprint occurs more than once over all partitions.
3. Each partition reads the answer to it from the shared folder; rows with a set bit are suspects. Only suspects are
   shuffled, and equal bytes, not equal fingerprints, decide.

A fingerprint that a partition hasn't sent makes its row a suspect. A false suspect costs a comparison and never
changes a result. Input that is more than a scan of files is written to the shared folder first, so that both passes
find the same rows in the same partitions.

Nulls: a null text is equal to nothing and its row is kept. Empty texts are equal to each other. Of equal texts the row
with the least doc_id stays, nulls last; of rows equal in text and doc_id one stays. Texts of any
length are compared whole. Other columns, whatever their names, are kept or ignored as they are. An empty table gives an
empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.session import new_table_path
from webloom.tables import table

from ._aligned import by_part, pinned
from ._cols import pick, restore, with_picked

FP_BITS = 48
OWNER_ROWS = 8_000_000  # the most fingerprints of an owner, on average

SQL = """
WITH r AS (
  SELECT doc_id, row_number() OVER w AS n, first_value(doc_id) OVER w AS kept_doc_id
  FROM documents WHERE text IS NOT NULL
  WINDOW w AS (PARTITION BY text ORDER BY doc_id NULLS LAST)
)
SELECT doc_id, kept_doc_id FROM r WHERE n > 1
"""


def rice_encode(values: np.ndarray) -> bytes:
    """Sorted non-negative integers as count, parameter, first value, unary quotients of the gaps, then remainders."""
    n = len(values)
    if n == 0:
        return np.zeros(3, "<u8").tobytes()
    gaps = np.diff(values.astype(np.uint64))
    k = max(0, int(np.log2(max(1.0, float(gaps.mean()) * 0.6931)))) if n > 1 else 0
    quotients = (gaps >> np.uint64(k)).astype(np.int64)
    unary = np.ones(int(quotients.sum()) + n - 1, np.uint8)
    unary[np.cumsum(quotients + 1) - 1] = 0
    planes = ((gaps[:, None] >> np.arange(k, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8)
    head = np.array([n, k, int(values[0])], "<u8").tobytes()
    return head + len(unary).to_bytes(8, "little") + np.packbits(unary).tobytes() + np.packbits(planes.ravel()).tobytes()


def rice_decode(blob: bytes) -> np.ndarray:
    n, k, first = (int(x) for x in np.frombuffer(blob, "<u8", 3))
    if n == 0:
        return np.zeros(0, np.uint64)
    bits = int.from_bytes(blob[24:32], "little")
    to = 32 + (bits + 7) // 8
    unary = np.unpackbits(np.frombuffer(blob, np.uint8, to - 32, 32), count=bits)
    stops = np.flatnonzero(unary == 0)
    gaps = (np.diff(stops, prepend=-1) - 1).astype(np.uint64) << np.uint64(k)
    if k and n > 1:
        planes = np.unpackbits(np.frombuffer(blob, np.uint8, offset=to), count=(n - 1) * k).reshape(n - 1, k)
        gaps += (planes.astype(np.uint64) << np.arange(k, dtype=np.uint64)).sum(1, dtype=np.uint64)
    out = np.empty(n, np.uint64)
    out[0] = first
    out[1:] = np.uint64(first) + np.cumsum(gaps, dtype=np.uint64)
    return out


def fingerprint(text: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text), 64 - FP_BITS)


def _send(owners: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, part = [], 0
        for b in batches:
            seen.append(b.column("fp").to_numpy(zero_copy_only=False).astype(np.uint64))
            part = b.column("part")[0].as_py() if b.num_rows else part
        fps = np.sort(np.concatenate(seen)) if seen else np.zeros(0, np.uint64)
        if not len(fps):
            return
        step = -(-(1 << FP_BITS) // owners)
        bounds = np.searchsorted(fps, np.arange(owners + 1, dtype=np.uint64) * np.uint64(step))
        rows = [(part, o, rice_encode(fps[a:b])) for o, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])) if b > a]
        p, o, blob = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(o, pa.int32()), pa.array(blob, pa.binary())], ["part", "owner", "blob"])

    return run


def _answer(got: pa.Table) -> pa.Table:
    parts, blobs = got.column("part").to_pylist(), got.column("blob").to_pylist()
    lists = [rice_decode(b) for b in blobs]
    everything = np.concatenate(lists) if lists else np.zeros(0, np.uint64)
    order = np.argsort(everything, kind="stable")
    ranked = everything[order]
    same = np.concatenate(([False], ranked[1:] == ranked[:-1]))
    repeated = same.copy()
    repeated[:-1] |= same[1:]
    flags = np.empty(len(ranked), bool)
    flags[order] = repeated
    at = 0
    bitmaps = []
    for one in lists:
        bitmaps.append(np.packbits(flags[at : at + len(one)]).tobytes())
        at += len(one)
    return pa.table({"part": pa.array(parts, pa.int32()), "blob": pa.array(blobs, pa.binary()), "bitmap": pa.array(bitmaps, pa.binary())})


def _read_answer(base: str, part: int) -> tuple[np.ndarray, np.ndarray]:
    """(known fingerprints, repeated ones) of a partition."""
    import pyarrow.dataset as ds
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(f"{base}/part={part}")
    if store.get_file_info(path).type == fs.FileType.NotFound:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    rows = ds.dataset(path, filesystem=store, format="parquet").to_table(columns=["blob", "bitmap"])
    known, repeated = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    for blob, bitmap in zip(rows.column("blob").to_pylist(), rows.column("bitmap").to_pylist()):
        fps = rice_decode(blob)
        known.append(fps)
        repeated.append(fps[np.unpackbits(np.frombuffer(bitmap, np.uint8), count=len(fps)).astype(bool)])
    return np.sort(np.concatenate(known)), np.sort(np.concatenate(repeated))


def _has(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_values):
        return np.zeros(len(x), bool)
    return sorted_values[np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)] == x


def suspicion(spark: SparkSession, fps: DataFrame, n_rows: int):
    """Runs the exchange over (fp, part); a function of these columns then says whether a row is a suspect."""
    owners = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // OWNER_ROWS))
    base = new_table_path(spark, "answers")
    (
        fps.mapInArrow(_send(owners), "part int, owner int, blob binary")
        .groupBy("owner")
        .applyInArrow(_answer, "part int, blob binary, bitmap binary")
        .repartition("part")
        .write.partitionBy("part")
        .parquet(base)
    )

    @F.pandas_udf("boolean")
    def is_suspect(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for x, (known, repeated) in by_part(batches, lambda part: _read_answer(base, part)):
            x = x.astype(np.uint64)
            yield pd.Series(_has(repeated, x) | ~_has(known, x))

    return is_suspect.asNondeterministic()


def duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, kept_doc_id) of each row that isn't kept."""
    spark, docs = docs.sparkSession, pinned(docs)
    rows = pick(docs, doc_id="bigint", text="string").filter("text IS NOT NULL").withColumns({"fp": fingerprint(F.col("text")), "part": F.spark_partition_id()})
    suspects = rows.filter(suspicion(spark, rows.select("fp", "part"), docs.count())("fp", "part"))
    by_id = suspects.groupBy("fp", "text", "doc_id").agg(F.count("*").alias("n"))
    kept = by_id.groupBy("fp", "text").agg(F.min("doc_id").alias("kept_doc_id"), F.sum("n").alias("rows")).filter("rows > 1")
    lost = F.col("n") - F.when(F.col("doc_id").eqNullSafe(F.col("kept_doc_id")), 1).otherwise(0)
    return by_id.join(kept, ["fp", "text"]).select("doc_id", "kept_doc_id", F.explode(F.array_repeat(F.lit(1), lost.cast("int"))).alias("one")).drop("one")


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one row of each text: the columns as they came."""
    spark, docs = docs.sparkSession, pinned(docs)
    rows, positions = with_picked(docs, doc_id="bigint", text="string")
    rows = rows.withColumns({"wl_fp": fingerprint(F.col("wl_text")), "wl_part": F.spark_partition_id()})
    suspect = suspicion(spark, rows.filter("wl_text IS NOT NULL").select(F.col("wl_fp").alias("fp"), F.col("wl_part").alias("part")), docs.count())
    marked = rows.withColumn("wl_suspect", F.col("wl_text").isNotNull() & suspect("wl_fp", "wl_part"))
    alone = marked.filter("NOT wl_suspect").select(*positions)
    whole = F.struct(*positions)
    one = marked.filter("wl_suspect").groupBy("wl_fp", "wl_text").agg(F.min_by(whole, F.struct(F.col("wl_doc_id").isNull(), "wl_doc_id")).alias("wl_row")).select("wl_row.*")
    return restore(alone.unionByName(one), positions, docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents"))
