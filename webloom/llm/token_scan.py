"""Token counts by a scan for separators.

A flat token file is a run of little-endian 16-bit token ids in which END_OF_DOCUMENT ends every document; it has no
index. Files are cut into blocks of BLOCK_TOKENS, whatever lies there. Each block is read by itself and searched for
separators as an array; documents within the block are counted at once. Documents that cross blocks are stitched from
the block summaries alone: a prefix sum of the blocks' separators numbers the documents, and a prefix maximum of the
last separator's place says how much of a block's first document lies before it.

Tokens after the last separator are a document too, if any. Two separators in a row enclose an empty document. An
empty file has none. A file whose size isn't two bytes for each token that it is listed with (an odd last byte, a cut-off
or grown file) is an error.

write_tokens() makes such files from documents in the shared folder: a null text is left out, an empty one gives an
empty document, and each task's file counts only if the task's result was kept. The ids of a file's documents are listed
beside it, so that counts can be given by doc_id. Vocabularies of more than 65,536 tokens, or with a token of the
separator's number, are an error. Repeated rows are separate documents. Very long texts are encoded in pieces of bounded
memory and may span blocks. Other columns, whatever their names, are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.session import materialize, new_table_path
from webloom.tables import table

from . import bpe
from ._cols import pick

BLOCK_TOKENS = 4 << 20
PIECE = 1 << 20
FILES = "file bigint, path string, n_tokens bigint, doc_ids array<bigint>"


def _write(base: str, vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        if len(tokens := bpe.codec(vocabulary).tokens) > 1 << 16 or (len(tokens) > bpe.END_OF_DOCUMENT and tokens[bpe.END_OF_DOCUMENT]):
            raise ValueError("the vocabulary doesn't leave the separator free in 16 bits")
        store, folder = fs.FileSystem.from_uri(base)
        store.create_dir(folder, recursive=True)
        part, n, end = TaskContext.get().partitionId(), 0, bpe.END_OF_DOCUMENT.to_bytes(4, "little")
        name = f"{part:06d}-{uuid.uuid4().hex[:12]}.bin"
        kept: list[int | None] = []
        with store.open_output_stream(f"{folder}/{name}") as out:
            for batch in batches:
                doc_ids = batch.column("doc_id").to_pylist()
                for a, _, ids in bpe.encode_batch(batch.column("text"), vocabulary):
                    kept += [doc_ids[a + i] for i, x in enumerate(ids) if x is not None]
                    data = np.frombuffer(b"".join(x + end for x in ids if x is not None), np.int32)
                    out.write(data.astype("<u2").tobytes())
                    n += len(data)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([f"{base}/{name}"]), pa.array([n], pa.int64()), pa.array([kept], pa.list_(pa.int64()))], ["file", "path", "n_tokens", "doc_ids"])

    return run


def write_tokens(docs: DataFrame, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """(file, path, n_tokens, doc_ids) of the token files written for docs."""
    base = new_table_path(docs.sparkSession, "tokens")
    return materialize(pick(docs, doc_id="bigint", text="string").mapInArrow(_write(base, vocabulary), FILES), "files")


def _scan(separator: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for file, path, whole, block, start, n in zip(*(c.to_pylist() for c in batch.columns)):
                store, at = fs.FileSystem.from_uri(path)
                found = []
                with store.open_input_file(at) as f:
                    if f.size() != 2 * whole:
                        raise ValueError(f"{path} has {f.size()} bytes instead of {2 * whole}")
                    for a in range(start, start + n, PIECE):
                        ids = np.frombuffer(f.read_at(2 * min(PIECE, start + n - a), 2 * a), "<u2")
                        found.append(np.flatnonzero(ids == separator) + a)
                stops = np.concatenate(found) if found else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], pa.int64()) for v in (file, block, start, start + n)] + [pa.array([stops], pa.list_(pa.int64()))],
                    ["file", "block", "start", "stop", "seps"],
                )

    return run


def count_tokens(files: DataFrame, separator: int = bpe.END_OF_DOCUMENT, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, doc, start, n_tokens) of every document of the files, in their order."""
    blocks = files.filter("n_tokens > 0").select("file", "path", "n_tokens", F.explode(F.sequence(F.lit(0), F.expr(f"(n_tokens - 1) div {block_tokens}"))).alias("block"))
    blocks = blocks.select("file", "path", "n_tokens", "block", (F.col("block") * block_tokens).alias("start"), F.least(F.lit(block_tokens), F.col("n_tokens") - F.col("block") * block_tokens).alias("n"))
    tasks = max(1, min(int(blocks.count()), 100_000))
    scanned = materialize(blocks.repartition(tasks, "file", "block").mapInArrow(_scan(separator), "file bigint, block bigint, start bigint, stop bigint, seps array<bigint>"), "blocks")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summary = scanned.select("file", "block", "stop", F.size("seps").alias("n"), F.element_at(F.when(F.size("seps") > 0, F.col("seps")), -1).alias("last"))
    stitched = summary.select(
        "file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), F.coalesce(F.max("last").over(before), F.lit(-1)).alias("prior"),
    )
    ends = scanned.join(stitched, ["file", "block"]).select("file", "first", "prior", "seps", F.posexplode("seps").alias("k", "at"))
    inner = ends.select("file", (F.col("first") + F.col("k")).alias("doc"), (F.when(F.col("k") == 0, F.col("prior")).otherwise(F.expr("get(seps, k - 1)")) + 1).alias("start"), "at")
    tail = summary.groupBy("file").agg(F.sum("n").alias("doc"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"), F.max("stop").alias("at")).filter("at > start")
    return inner.unionByName(tail.select("file", "doc", "start", "at")).select("file", "doc", "start", (F.col("at") - F.col("start")).alias("n_tokens"))


def counts(docs: DataFrame, vocabulary: str = bpe.VOCABULARY) -> DataFrame:
    """(doc_id, file, doc, start, n_tokens) of every document with a text, by way of token files."""
    files = write_tokens(docs, vocabulary)
    ids = files.select("file", F.posexplode("doc_ids").alias("doc", "doc_id"))
    return count_tokens(files).join(ids.withColumn("doc", F.col("doc").cast("bigint")), ["file", "doc"]).select("doc_id", "file", "doc", "start", "n_tokens")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts(table(spark, sf_dir, "documents"))
