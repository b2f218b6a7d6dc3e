"""Duplicate gates of the index: exact by digest, near by SimHash, both resolved in arrival order."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from hashlib import md5
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from webloom.functions.text import squash
from webloom.session import bound_batches, materialize

RADIUS = 3
BLOCKS = (11, 11, 11, 11, 10, 10)  # bits; a pair within the radius shares three of the six
WORDS_HELD = 1 << 20


def simhash(docs: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """(key, simhash): the bitwise majority of the MD5s of lower-cased words, as a signed 64-bit number.

    All words of a document are in its row, so each row votes by itself, without a shuffle. Texts without words have none;
    they are left out in Python, as a filter on the hash would be pushed below it and have every text voted on twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, bytes] = {}
        for batch in batches:
            hashes = [_vote(t.as_py(), held) for t in batch.column(1)]
            one = pa.RecordBatch.from_arrays([batch.column(0), pa.array(hashes, pa.int64())], names=[key, "simhash"])
            yield one.filter(one.column(1).is_valid())

    bound_batches(docs.sparkSession)
    plain = docs.select(key, F.lower(squash(F.col(text))).alias("plain"))
    return plain.mapInArrow(run, StructType([plain.schema[0], StructField("simhash", LongType())]))


def _vote(text: str | None, held: dict[str, bytes]) -> int | None:
    """The hash of a text; held: digests of words seen before, in which only the text's own words are looked up."""
    counts = Counter(text.split(" ")) if text else {}
    counts.pop("", None)
    if not counts:
        return None
    if len(held) > WORDS_HELD:
        held.clear()
    for w in counts:
        if w not in held:
            held[w] = md5(w.encode()).digest()[:8]
    bits = np.unpackbits(np.frombuffer(b"".join(map(held.__getitem__, counts)), np.uint8).reshape(-1, 8), axis=1)
    n = np.fromiter(counts.values(), np.int64, len(counts))
    return int(np.packbits(2 * (n @ bits) > n.sum()).view(">i8")[0])


def classes(hashes: DataFrame, key: str = "id") -> DataFrame:
    """(id, first): the least id with the same hash, which stands for them all."""
    least = hashes.groupBy("simhash").agg(F.min(key).alias("first"))
    return hashes.select(F.col(key).alias("id"), "simhash").join(least, "simhash").select("id", "first")


def near_pairs(hashes: DataFrame, key: str = "id", radius: int = RADIUS) -> DataFrame:
    """(a, b) with a < b of different hashes within the radius, of the least ids of each hash: see classes() for the others.

    A row is filed under each three of the six blocks, some 32 bits, so that few chance pairs meet."""
    if radius > len(BLOCKS) // 2:
        raise ValueError("the radius must be at most half the number of blocks")
    at = [sum(BLOCKS[:i]) for i in range(len(BLOCKS))]
    first = hashes.groupBy("simhash").agg(F.min(key).alias("id"))
    keys = [F.col("simhash").bitwiseAND(F.lit(_signed(sum(((1 << BLOCKS[i]) - 1) << at[i] for i in three)))) for three in combinations(range(len(BLOCKS)), 3)]
    filed = first.select("id", "simhash", F.posexplode(F.array(*keys)).alias("i", "band"))
    a, b = filed.alias("a"), filed.alias("b")
    close = F.bit_count(F.col("a.simhash").bitwiseXOR(F.col("b.simhash"))) <= radius
    met = a.join(b, (F.col("a.i") == F.col("b.i")) & (F.col("a.band") == F.col("b.band")) & (F.col("a.id") < F.col("b.id")) & close)
    return met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()


def _signed(bits: int) -> int:
    return bits - (1 << 64) if bits >> 63 else bits


def greedy_keep(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, keep): a document is kept unless it is near one kept before it, in order of id.

    That is the lexicographically first independent set: in each round, undecided documents without an undecided earlier
    neighbour are kept and their later neighbours dropped. Each round is written out, so a lost executor costs a reread.
    """
    pairs = materialize(pairs.select("a", "b"), "pairs")
    touched = pairs.select(F.col("a").alias("id")).union(pairs.select(F.col("b").alias("id"))).distinct()
    undecided = materialize(touched, "undecided")
    dropped = None
    while undecided.take(1):
        live = pairs.join(undecided.select(F.col("id").alias("a")), "a", "left_semi").join(undecided.select(F.col("id").alias("b")), "b", "left_semi").select("a", "b")
        live = materialize(live, "live")
        kept = undecided.join(live.select(F.col("b").alias("id")).distinct(), "id", "left_anti")
        lost = materialize(live.join(kept.select(F.col("id").alias("a")), "a", "left_semi").select(F.col("b").alias("id")).distinct(), "lost")
        dropped = lost if dropped is None else dropped.union(lost)
        undecided = materialize(undecided.join(kept, "id", "left_anti").join(lost, "id", "left_anti"), "undecided")
    if dropped is None:
        return nodes.select("id", F.lit(True).alias("keep"))
    gone = dropped.withColumn("gone", F.lit(True))
    return nodes.select("id").join(gone, "id", "left").select("id", F.col("gone").isNull().alias("keep"))


def exact_first(digest: str = "sha256") -> Column:
    """Whether a row is the first of its digest, by id."""
    return F.row_number().over(Window.partitionBy(digest).orderBy("id")) == 1


def gate_duplicates(docs: DataFrame) -> DataFrame:
    """(id, verdict) of documents (id, sha256, simhash): dup-exact, dup-near or index.

    A digest counts as seen even if its first document turns out a near-duplicate, so later copies are dup-exact. Of equal
    hashes only the first document can be kept: what it is near is earlier than the others too."""
    marked = materialize(docs.select("id", "simhash", exact_first().alias("first")), "marked")
    firsts = marked.filter("first")
    of = materialize(classes(firsts), "classes")
    heads = greedy_keep(of.filter("id = first"), near_pairs(firsts))
    keep = of.select("id").join(heads, "id", "left").select("id", F.coalesce("keep", F.lit(False)).alias("keep"))
    verdict = F.when(~F.col("first"), "dup-exact").when(~F.col("keep"), "dup-near").otherwise("index")
    return marked.join(keep, "id", "left").select("id", verdict.alias("verdict"))
