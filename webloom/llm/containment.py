"""Near-duplicate documents by a MinHash containment ensemble.

Two documents are linked if the smaller one's set of SHINGLE-word shingles is contained in the other's to at least
CONTAINMENT. Links of sets up to RATIO apart in size join their documents: groups are the connected components, and of
each the row with the least doc_id stays, nulls last. A link to a set more than RATIO times as large goes one way: a
group is absorbed if one of its largest sets is contained in such a set, and what stays in its place is what stays for
that set's group. So a short text that many long ones hold doesn't join these. Sizes grow along absorptions, so they end.

1. Every row gets its shingle set, MinHash values, and a 128-bit sketch of one bit a hash. Rows with equal sets
   are one node from here on.
2. Nodes are partitioned by set size in powers of two. A partition's least Jaccard similarity of a pair up to RATIO apart
   follows from the containment threshold and the sizes that can meet there; bands and rows are tuned to it so
   that such a pair shares a band with probability RECALL. A node is filed under its own partition's bands, and asks in
   the next one's if its size allows partners there.
3. In each bucket every node is paired with the bucket's leader, of eight orders of precedence by turns; sketches and
   sizes drop most chance pairs. Of each node the pair of nearest sketches is verified: its texts are brought together
   and containment is computed exactly from whole texts. That joins most of each group, and each text is sent once; then
   the other pairs with ends in two groups are verified.
4. Towards larger partitions the Jaccard threshold of a containment falls so low that a band has one row: the MinHash
   values of the smaller set are looked up by themselves. A set's LEAST shingles of least hash are asked for in the whole
   sets of all nodes, by one aggregate over those that anyone asks for (a bitmap keeps most others from the shuffle), and
   counted where sets of other groups and of the right sizes hold them. Sets with too few of these are linked to no other
   group. Those left, a few, ask for MORE, which are counted in the same way; then the rarest of them, of which a link
   holds MARKS, give candidates, and those that share ENOUGH are verified from whole texts. Absorption needs one
   container, so the largest holder is tried first. So pairs are made where a link is likely and not for each that shares
   a passage.
5. Components are found by large-star and small-star rounds, absorptions followed by pointer jumping.

Nulls: a null text, and one without words, is near nothing; its row stays. A text of fewer than SHINGLE words is a
single shingle. Rows with equal texts are near-duplicates; of rows equal in text and doc_id one stays. Very long texts
are read whole, in vectorised pieces. Of containers of equal size the least hash decides. Other columns, whatever their
names, are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.session import bound_batches, materialize, new_table_path
from webloom.tables import table

from ._aligned import CLEAR, marker, pinned, read_part
from ._cols import pick, restore, with_picked
from ._text import U64, chunks, mix, shingle_sets

SHINGLE = 4
CONTAINMENT = 0.7
RATIO = 1.5
RECALL = 0.93
HASHES = 64
SKETCH_SLACK = 3.5  # standard deviations of the sketch's estimate below the least similarity
CHUNK_ROWS = 512
MARKS = 5  # of the rarest shingles of a set, how many a candidate must hold
LEAST, FOUND = 16, 7  # shingles of a set asked for in others; how many others must hold (a link at the least containment misses it once in 140 times)
MORE, ENOUGH = 48, 24  # the same of the sets left (once in 1000 times)
MAX_BITMAP = 1 << 29  # bits
BLOCK_ROWS, BLOCK_SHINGLES = 2048, 1 << 19  # sets and their shingles in a chunk, about

_seeds = np.random.default_rng(20)
_A = _seeds.integers(1, 1 << 63, HASHES + 128, dtype=np.uint64) | U64(1)
_B = _seeds.integers(0, 1 << 63, HASHES + 128, dtype=np.uint64)


def size_class(n: int) -> int:
    return n.bit_length() - 1


@lru_cache(None)
def least_jaccard(c: int) -> float:
    """The least similarity of a near-duplicate pair up to RATIO apart whose larger set is of class c (2^c up to 2^(c+1) - 1)."""
    lo, hi = 1 << c, (1 << (c + 1)) - 1
    sizes = range(lo, hi + 1) if c < 8 else (lo, hi)
    worst = 1.0
    for u in sizes:
        least = max(1, math.ceil(u / RATIO))
        for q in range(least, u + 1) if c < 8 else (least, u):
            shared = math.ceil(CONTAINMENT * q - 1e-9)
            worst = min(worst, shared / (q + u - shared))
    return worst


@lru_cache(None)
def banding(c: int) -> tuple[int, int]:
    """(bands, rows) for class c: the most rows that HASHES allow at the recall wanted."""
    s = least_jaccard(c)
    for rows in range(6, 0, -1):
        p = s**rows
        bands = 1 if p >= RECALL else math.ceil(math.log(1 - RECALL) / math.log(1 - p))
        if bands * rows <= HASHES:
            return max(bands, 2), rows
    return HASHES, 1


def sketch_distance(c: int) -> int:
    """The most of 128 sketch bits in which a pair of class c is let differ."""
    match = 0.5 + 0.5 * least_jaccard(c)
    return math.ceil(128 * (1 - match) + SKETCH_SLACK * math.sqrt(128 * match * (1 - match)))


def _keys(minima: np.ndarray, c: int) -> list[int]:
    bands, rows = banding(c)
    block = minima[: bands * rows].reshape(bands, rows)
    key = np.full(bands, c + 1, U64) * U64(0x9E3779B97F4A7C15) + np.arange(bands, dtype=U64)
    for j in range(rows):
        key = mix(key ^ block[:, j]) + U64(j)
    return key.view(np.int64).tolist()


SKETCHED = "part int, doc_id bigint, t_hi bigint, t_lo bigint, set_hi bigint, set_lo bigint, n int, sk_hi bigint, sk_lo bigint, far int, bands array<bigint>, least array<bigint>"
_ARROW = pa.schema(
    [("part", pa.int32())]
    + [(n, pa.int64()) for n in ("doc_id", "t_hi", "t_lo", "set_hi", "set_lo")]
    + [("n", pa.int32()), ("sk_hi", pa.int64()), ("sk_lo", pa.int64()), ("far", pa.int32()), ("bands", pa.list_(pa.int64())), ("least", pa.list_(pa.int64()))]
)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text")
        for a, b in chunks(texts):
            sets = shingle_sets(texts.slice(a, b - a), SHINGLE)
            keep = np.flatnonzero([len(s) > 0 for s in sets])
            if not len(keep):
                continue
            sets = [sets[i] for i in keep]
            flat = np.concatenate(sets)
            at = np.concatenate(([0], np.cumsum([len(s) for s in sets])[:-1]))
            minima = np.empty((len(sets), HASHES + 128), U64)
            for h in range(HASHES + 128):
                minima[:, h] = np.minimum.reduceat(flat * _A[h] + _B[h], at)
            bits = np.packbits(((mix(minima[:, HASHES:]) >> U64(17)) & U64(1)).astype(np.uint8), axis=1).view(np.int64)
            hi = np.add.reduceat(mix(flat), at)
            lo = np.add.reduceat(mix(flat ^ U64(0xA5A5A5A5A5A5A5A5)), at)
            sizes = np.array([len(s) for s in sets], np.int64)
            bands, far = [], []
            for i, n in enumerate(sizes.tolist()):
                c = size_class(n)
                keys = _keys(minima[i], c)
                if math.floor(n * RATIO) >= 1 << (c + 1):
                    keys += _keys(minima[i], c + 1)
                bands.append(keys)
                far.append(sketch_distance(c + 1))
            rows = batch.slice(a, b - a).take(pa.array(keep))
            yield pa.RecordBatch.from_arrays(
                [rows.column("part"), rows.column("doc_id"), rows.column("t_hi"), rows.column("t_lo"), pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(sizes.astype(np.int32))]
                + [pa.array(np.ascontiguousarray(bits[:, 0])), pa.array(np.ascontiguousarray(bits[:, 1])), pa.array(far, pa.int32()), pa.array(bands, pa.list_(pa.int64())), pa.array([x[:LEAST].view(np.int64) for x in sets], pa.list_(pa.int64()))],
                schema=_ARROW,
            )


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def near(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two non-empty shingle sets are linked."""
    return _shared(a, b) >= CONTAINMENT * min(len(a), len(b)) - 1e-9


def joins(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether they are linked and near in size."""
    return max(len(a), len(b)) <= RATIO * min(len(a), len(b)) and near(a, b)


def _verify(holds: Callable[[np.ndarray, np.ndarray], bool]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by (a, chunk), the leader's own text first."""
        leader, held = None, None
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            texts = batch.column("text")
            left, right = [], []
            for i, j in chunks(texts):
                for x, y, s in zip(a[i:j], b[i:j], shingle_sets(texts.slice(i, j - i), SHINGLE)):
                    if x == y:
                        leader, held = x, s
                    elif leader == x and holds(held, s):
                        left.append(x)
                        right.append(y)
            if left:
                yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    return run


def _led(nodes: DataFrame) -> DataFrame:
    """(a, b, differ): each node of a bucket with the bucket's leader, if sizes and sketches let them be linked."""
    filed = nodes.select("node", F.explode("bands").alias("key"))
    # the least or the greatest of the numbers under one of four masks
    mask = F.xxhash64(F.pmod("key", F.lit(4)))
    masked = filed.withColumn("o", F.col("node").bitwiseXOR(mask)).groupBy("key").agg(F.min("o").alias("lo"), F.max("o").alias("hi")).filter("lo <> hi")
    lead = masked.select("key", F.when(F.pmod(F.shiftright("key", 2), F.lit(2)) == 0, F.col("lo")).otherwise(F.col("hi")).bitwiseXOR(mask).alias("lead"))
    pairs = filed.join(lead, "key").filter("lead <> node").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct()
    for end in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in ("n", "sk_hi", "sk_lo", "far")]), end)
    differ = F.expr("bit_count(a_sk_hi ^ b_sk_hi) + bit_count(a_sk_lo ^ b_sk_lo)")
    near_size = F.greatest("a_n", "b_n") <= F.lit(RATIO) * F.least("a_n", "b_n")
    return pairs.withColumn("differ", differ).filter(near_size & (F.col("differ") <= F.greatest("a_far", "b_far"))).select("a", "b", "differ")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends aren't in one group."""
    for end in ("a", "b"):
        pairs = pairs.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), end, "left")
    return pairs.filter(F.coalesce("a_root", "a") != F.coalesce("b_root", "b")).select("a", "b")


def _ends(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _bitmap(hashes: DataFrame, n: int, bits_each: int) -> np.ndarray:
    """A bit for each of n hashes, by their first bits: as small sets are few, there are few bits for great hashes, and
    most of them don't pass however many there are of small ones. The size is a multiple of n, up to MAX_BITMAP."""
    bits = min(MAX_BITMAP, max(1 << 15, 1 << (bits_each * n).bit_length()))
    at = F.shiftrightunsigned("h", 64 - (bits.bit_length() - 1)) + 1
    words = hashes.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    out = np.zeros(bits >> 3, np.uint8)
    for k, word in words.toLocalIterator():
        out[(k - 1) << 12 : k << 12] = np.frombuffer(word, np.uint8)
    return out


HOLDERS = "h bigint, node bigint, root bigint, n int, tag bigint"


def _places(base: str, part: int) -> tuple[np.ndarray, ...]:
    """(t_hi, sorted; node, root, tag) on record for a partition."""
    rows = read_part(base, part, ["t_hi", "node", "root", "tag"])
    if rows is None:
        return (np.zeros(0, np.int64),) * 4
    t = rows.column("t_hi").to_numpy()
    order = np.argsort(t, kind="stable")
    return (t[order], *(rows.column(c).to_numpy()[order] for c in ("node", "root", "tag")))


def _holders(texts: DataFrame, base: str, hashes: DataFrame, bits_each: int) -> DataFrame:
    """(h, node, root, n, tag) of the shingles among hashes (and some others) in all texts. A node may recur."""
    held = texts.sparkSession.sparkContext.broadcast(_bitmap(hashes, hashes.count(), bits_each))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, part, places = held.value, None, None
        shift = U64(64 - ((len(bitmap) << 3).bit_length() - 1))
        for batch in batches:
            if not batch.num_rows:
                continue
            if part != (part := batch.column("part")[0].as_py()):
                places = _places(base, part)
            text, t_hi = batch.column("text"), batch.column("t_hi").to_numpy()
            for i, j in chunks(text):
                sets = shingle_sets(text.slice(i, j - i), SHINGLE)
                flat, size = np.concatenate(sets), np.array([len(x) for x in sets])
                at = (flat >> shift).astype(np.int64)
                seen = np.flatnonzero(bitmap[at >> 3] >> (at & 7).astype(np.uint8) & 1)
                row = np.repeat(np.arange(j - i), size)[seen]
                if len(row):
                    where = np.minimum(np.searchsorted(places[0], t_hi[i:j][row]), len(places[0]) - 1)
                    if not len(places[0]) or (places[0][where] != t_hi[i:j][row]).any():
                        raise ValueError("a partition's rows have changed since the sketches were written")
                    columns = [flat[seen].view(np.int64), places[1][where], places[2][where], size[row].astype(np.int32), places[3][where]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "node", "root", "n", "tag"])

    return texts.select("part", "t_hi", "text").mapInArrow(run, HOLDERS)


def _needed(n: str, sample: int, enough: int) -> Column:
    """How many of the shingles asked for a link must hold, of a set of n."""
    return F.when(F.col(n) <= sample, F.ceil(CONTAINMENT * F.col(n) - 1e-9)).otherwise(enough)


def _class(n: str) -> Column:
    return F.length(F.bin(n)) - 1


def _first_shingles(texts: DataFrame, sketched: DataFrame, wanted: DataFrame, most: int | None) -> DataFrame:
    """(t_hi, t_lo, h): the shingles of least hash of the wanted texts, so many at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            for i, j in chunks(text):
                sets = [x[:most] for x in shingle_sets(text.slice(i, j - i), SHINGLE)]
                row = pa.array(np.repeat(np.arange(i, j), [len(x) for x in sets]))
                yield pa.RecordBatch.from_arrays([batch.column("t_hi").take(row), batch.column("t_lo").take(row), pa.array(np.concatenate(sets).view(np.int64))], ["t_hi", "t_lo", "h"])

    mine = texts.filter(marker(_flags(sketched, wanted))("t_hi", "part") != CLEAR)
    return mine.groupBy("t_hi", "t_lo").agg(F.min("text").alias("text")).mapInArrow(run, "t_hi bigint, t_lo bigint, h bigint")


def _rarest(asked: DataFrame, df: str, need: Column) -> DataFrame:
    """(q, q_root, q_n, least, h): of each set's shingles asked for, so many of the rarest that any set that shares enough
    of all holds at least so many of these.

    asked: (q, q_root, q_n, h, df) of the shingles that are held at all; sets with fewer of these than they need go."""
    of_set = Window.partitionBy("q")
    ranked = asked.withColumns({"support": F.count("*").over(of_set), "rank": F.row_number().over(of_set.orderBy(df, "h")), "need": need})
    ranked = ranked.withColumn("least", F.least(F.lit(MARKS), "need"))
    fits = (F.col("support") >= F.col("need")) & (F.col("rank") <= F.col("support") - F.col("need") + F.col("least"))
    return ranked.filter(fits).select("q", "q_root", "q_n", "least", "h")


def _met(rarest: DataFrame, holders: DataFrame, fits: Column) -> DataFrame:
    """(q, q_root, q_n, node, root, n, tag): pairs that share enough of the rarest shingles."""
    pair = ["q", "q_root", "q_n", "node", "root", "n", "tag", "least"]
    return rarest.join(holders, "h").filter(fits).groupBy(pair).agg(F.count("*").alias("times")).filter("times >= least").drop("times", "least")


def _counted(pairs: DataFrame, asked: DataFrame, holders: DataFrame) -> DataFrame:
    """The pairs (q, node, ...) of which the second holds enough of the shingles asked for by the first."""
    met = pairs.select("q", "node").join(asked.select("q", "q_n", "h"), "q").join(holders.select("h", "node"), ["h", "node"])
    enough = met.groupBy("q", "node").agg(F.count("*").alias("times"), F.first("q_n").alias("q_n")).filter(F.col("times") >= _needed("q_n", MORE, ENOUGH))
    return pairs.join(enough.select("q", "node"), ["q", "node"])


def _wholly(texts: DataFrame, sketched: DataFrame, base: str, askers: DataFrame) -> DataFrame:
    """(q, q_root, q_n, node, root, n, tag): of the askers (q, q_root, q_n, t_hi, t_lo), by all shingles they have, those
    of which enough are in sets over RATIO as large, with the sets of these that hold enough of the rarest."""
    whole = _first_shingles(texts, sketched, askers.select("t_hi", "t_lo"), None).join(askers, ["t_hi", "t_lo"])
    whole = materialize(whole.select("q", "q_root", "q_n", "h"), "whole")
    hashes = whole.select("h").distinct()
    holders = materialize(_holders(texts, base, hashes, 96).join(hashes, "h", "left_semi").distinct(), "holders")
    of_hash = holders.groupBy("h").agg(F.max("n").alias("most"), F.count("*").alias("df"))
    above = whole.join(of_hash, "h").filter(F.col("most") > F.lit(RATIO) * F.col("q_n"))
    rarest = materialize(_rarest(above, "df", F.ceil(CONTAINMENT * F.col("q_n") - 1e-9)), "rarest")
    return _met(rarest, holders, F.col("n") > F.lit(RATIO) * F.col("q_n"))


def _asked(texts: DataFrame, sketched: DataFrame, nodes: DataFrame, edges: DataFrame, absorb: bool) -> tuple[DataFrame, DataFrame]:
    """edges and the links found between groups of sets up to RATIO apart; and, if absorb, (root, into, n, tag, q_n): containers of groups."""
    joined = materialize(components(edges), "joined")
    rooted = nodes.join(joined, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rooted = materialize(rooted.select("node", "root", "n", "t_hi", "t_lo", "set_hi", "set_lo", "least"), "rooted")
    base = new_table_path(texts.sparkSession, "places")
    place = sketched.select("part", "t_hi", "set_hi", "set_lo").distinct().join(rooted.select("set_hi", "set_lo", "node", "root", F.col("t_hi").alias("tag")), ["set_hi", "set_lo"])
    place.select("part", "t_hi", "node", "root", "tag").repartition("part").write.partitionBy("part").parquet(base)
    # a group is asked for in larger sets by its largest ones
    top = rooted.groupBy("root").agg(F.max("n").alias("most"))
    rooted = rooted.join(top, "root").withColumn("largest", F.lit(absorb) & (F.col("n") == F.col("most"))).drop("most")
    of_q = [F.col("node").alias("q"), F.col("root").alias("q_root"), F.col("n").alias("q_n"), "largest"]
    least = rooted.select(*of_q, F.explode("least").alias("h"))
    by_class = _holders(texts, base, least.select("h"), 12).groupBy("h", _class("n").alias("c")).agg(F.min("root").alias("first"), F.max("root").alias("last"), F.max("n").alias("most"))
    other = (F.col("first") != F.col("q_root")) | (F.col("last") != F.col("q_root"))
    # sets up to RATIO apart are of a set's own class or the next
    near_by = other & F.col("c").between(_class("q_n"), _class("q_n") + 1)
    above = F.col("largest") & (F.col("most") > F.lit(RATIO) * F.col("q_n"))
    found = least.join(by_class, "h").filter(near_by | above).groupBy("q", "h").agg(F.first("q_n").alias("q_n"), F.max(near_by).alias("near_by"), F.max(above).alias("above"))
    found = found.groupBy("q").agg(F.first("q_n").alias("q_n"), F.count_if("near_by").alias("near_by"), F.count_if("above").alias("above"))
    enough = found.filter(F.greatest("near_by", "above") >= _needed("q_n", LEAST, FOUND)).select("q")
    some = materialize(rooted.select(*of_q, "t_hi", "t_lo").join(enough, "q"), "askers")
    asked = _first_shingles(texts, sketched, some.select("t_hi", "t_lo"), MORE).join(some, ["t_hi", "t_lo"]).select("q", "q_root", "q_n", "largest", "h")
    asked = materialize(asked, "asked")
    holders = materialize(_holders(texts, base, asked.select("h").distinct(), 48).join(asked.select("h").distinct(), "h", "left_semi").distinct(), "holders")

    by_class = holders.groupBy("h", _class("n").alias("c")).agg(F.count("*").alias("df"), F.min("root").alias("first"), F.max("root").alias("last"))
    held = asked.join(by_class, "h").filter(near_by).groupBy("q", "q_n", "q_root", "h").agg(F.sum("df").alias("df"))
    fits = (F.col("n") >= F.col("q_n")) & (F.col("n") <= F.lit(RATIO) * F.col("q_n")) & (F.col("root") != F.col("q_root"))
    met = _rarest(held, "df", _needed("q_n", MORE, ENOUGH)).join(holders, "h").filter(fits).groupBy("q", "node", "least").agg(F.count("*").alias("times")).filter("times >= least")
    edges = edges.unionByName(_joined_in_blocks(texts, sketched, nodes, materialize(met.select(*_ends("q", "node")).distinct(), "met"), joined))
    if not absorb:
        return edges, edges.limit(0)

    who = F.struct("n", F.bitwise_not("tag").alias("tag"), "node", "root")
    of_hash = holders.groupBy("h").agg(F.max(who).alias("top"), F.count("*").alias("df"))
    above = asked.filter("largest").join(of_hash, "h").filter(F.col("top.n") > F.lit(RATIO) * F.col("q_n"))
    wide = materialize(above.select("q", "q_root", "q_n", "h", "df", "top", F.count("*").over(Window.partitionBy("q")).alias("support")).filter(F.col("support") >= _needed("q_n", MORE, ENOUGH)), "wide")
    tried = wide.groupBy("q", "q_n", "q_root", "top").agg(F.count("*").alias("times")).groupBy("q", "q_n", "q_root").agg(F.max(F.struct("times", "top")).alias("best"))
    pick_ = ["q", "q_n", "q_root", "node", "root", "n", "tag"]

    def contained(pairs: DataFrame) -> DataFrame:
        likely = materialize(_counted(pairs, asked, holders).select(*pick_), "likely")
        sure = _verified(texts, sketched, nodes, likely.select(F.col("node").alias("a"), F.col("q").alias("b")), near)
        return materialize(likely.join(sure.select(F.col("a").alias("node"), F.col("b").alias("q")), ["q", "node"]).select(*pick_), "contained")

    first = contained(tried.select("q", "q_n", "q_root", "best.top.node", "best.top.root", "best.top.n", "best.top.tag"))
    left = wide.join(first.select("q_root"), "q_root", "left_anti")
    # a passage that many hold is no container: those left must be held as a whole before pairs are made
    larger = _wholly(texts, sketched, base, some.join(left.select("q").distinct(), "q").select("q", "q_root", "q_n", "t_hi", "t_lo"))
    second = contained(larger.withColumn("tag", F.bitwise_not("tag")))
    return edges, first.unionByName(second).select(F.col("q_root").alias("root"), F.col("root").alias("into"), "n", "tag", "q_n")


def _flags(sketched: DataFrame, texts: DataFrame) -> DataFrame:
    """(part, h, flag) of every row: flagged are those with one of the texts (t_hi, t_lo)."""
    wanted = texts.select("t_hi", "t_lo", F.lit(True).alias("flag")).distinct()
    return sketched.select("part", "t_hi", "t_lo").join(wanted, ["t_hi", "t_lo"], "left").select("part", F.col("t_hi").alias("h"), "flag")


def _verified(docs: DataFrame, sketched: DataFrame, nodes: DataFrame, pairs: DataFrame, holds=joins) -> DataFrame:
    """The pairs (a, b) of which that holds."""
    many = pairs.groupBy("a").agg(F.count("*").alias("many"))
    placed = pairs.join(many, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.lit(1) + F.floor(F.col("many") / CHUNK_ROWS)).cast("int").alias("chunk"))
    wanted = placed.unionByName(placed.select("a", F.col("a").alias("b"), "chunk").distinct())
    asked = wanted.join(nodes.select(F.col("node").alias("b"), "t_hi", "t_lo"), "b")
    # only the texts of candidates leave their partitions, one of each
    mine = docs.filter(marker(_flags(sketched, asked))("t_hi", "part") != CLEAR)
    texts = mine.groupBy("t_hi", "t_lo").agg(F.min("text").alias("text"))
    rows = asked.join(texts, ["t_hi", "t_lo"]).select("a", "chunk", "b", "text")
    ordered = rows.repartition("a", "chunk").sortWithinPartitions("a", "chunk", (F.col("a") != F.col("b")))
    return ordered.select("a", "b", "text").mapInArrow(_verify(holds), "a bigint, b bigint")


def _verify_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block. Of the pairs asked for in a block, links between nodes that no others join yet."""
    block, held, asked = None, {}, []

    def settled() -> pa.RecordBatch:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (up := parent.get(x, x)) != x:
                parent[x] = parent.get(up, up)
                x = up
            return x

        left, right = [], []
        for b, others in asked:
            root, mine = held[b]
            for a in others:
                x, y = find(root), find(held[a][0])
                if x != y and joins(mine, held[a][1]):
                    parent[x] = y
                    left.append(a)
                    right.append(b)
        return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], ["a", "b"])

    for batch in batches:
        texts = batch.column("text")
        columns = [batch.column(c) for c in ("block", "node", "root", "others")]
        for i, j in chunks(texts):
            for at, node, root, others, s in zip(*[c.slice(i, j - i).to_pylist() for c in columns], shingle_sets(texts.slice(i, j - i), SHINGLE)):
                if at != block:
                    yield settled()
                    block, held, asked = at, {}, []
                held[node] = (root, s)
                if others:
                    asked.append((node, others))
    yield settled()


def _joined_in_blocks(docs: DataFrame, sketched: DataFrame, nodes: DataFrame, pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Links among the pairs (a, b), as many as join what all of those would. roots: (node, root) of what is joined.

    Where many texts share much, pairs are far more than texts. So the sets that pairs connect are split into chunks of at
    most BLOCK_ROWS and about BLOCK_SHINGLES, and a text is sent once for each two chunks with pairs, not for each pair."""
    met = components(pairs).withColumnRenamed("root", "comp").join(nodes.select("node", "n", "t_hi", "t_lo"), "node")
    met = materialize(met.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "met")
    parts = met.groupBy("comp").agg(F.ceil(F.greatest(F.sum("n") / BLOCK_SHINGLES, F.count("*") / BLOCK_ROWS)).alias("parts"))
    placed = met.join(parts, "comp").select("node", "comp", F.pmod(F.xxhash64("node"), "parts").alias("chunk"))
    for end in ("a", "b"):
        pairs = pairs.join(placed.select(F.col("node").alias(end), "comp", F.col("chunk").alias(f"{end}_chunk")), [end] if end == "a" else [end, "comp"])
    block = F.xxhash64("comp", F.least("a_chunk", "b_chunk"), F.greatest("a_chunk", "b_chunk"))
    ends = pairs.withColumn("block", block).select("block", F.explode(F.array(F.struct(F.col("b").alias("node"), F.col("a").alias("other")), F.struct(F.col("a").alias("node"), F.lit(None).cast("bigint").alias("other")))).alias("e"))
    asked = ends.groupBy("block", "e.node").agg(F.collect_list("e.other").alias("others")).join(met.select("node", "root", "t_hi", "t_lo"), "node")
    mine = docs.filter(marker(_flags(sketched, met))("t_hi", "part") != CLEAR)
    texts = mine.groupBy("t_hi", "t_lo").agg(F.min("text").alias("text"))
    rows = asked.join(texts, ["t_hi", "t_lo"]).select("block", "node", "root", "others", "text")
    return materialize(rows.repartition("block").sortWithinPartitions("block").mapInArrow(_verify_blocks, "a bigint, b bigint"), "verified")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge: the least node of its component. Alternating large and small stars."""
    edges = materialize(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        edges = materialize(small, "stars")
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now


def _tops(absorbed: DataFrame) -> DataFrame:
    """(root, top) of absorbed groups: the group that isn't absorbed at the end of the way. (root, into, n, tag): containers."""
    best = F.max_by("into", F.struct("n", "tag"))
    at = materialize(absorbed.groupBy("root").agg(best.alias("into")), "absorptions")
    while True:
        step = at.join(at.select(F.col("root").alias("into"), F.col("into").alias("next")), "into", "left")
        step = materialize(step.select("root", F.coalesce("next", "into").alias("into"), F.col("next").isNotNull().alias("moved")), "absorptions")
        if not step.filter("moved").take(1):
            return step.select("root", F.col("into").alias("top"))
        at = step.drop("moved")


def grouped(docs: DataFrame, absorb: bool) -> tuple[DataFrame, DataFrame]:
    """(doc_id, t_hi, t_lo, root, top, kept) of every row in a group of two or more or in an absorbed one; and the sketches
    of all rows. root is the row's group, top the one that stays for it, kept the doc_id that stays."""
    bound_batches(docs.sparkSession)
    rows = pick(docs, doc_id="bigint", text="string").filter("text IS NOT NULL")
    rows = rows.withColumns({"t_hi": F.xxhash64("text"), "t_lo": F.xxhash64(F.lit(7), "text"), "part": F.spark_partition_id()})
    sketched = materialize(rows.mapInArrow(_sketch, SKETCHED), "sketches")
    rest = F.struct("t_hi", "t_lo", "n", "sk_hi", "sk_lo", "far", "bands", "least")
    nodes = sketched.groupBy("set_hi", "set_lo").agg(F.min_by(rest, F.struct("t_hi", "t_lo")).alias("r")).select("set_hi", "set_lo", "r.*")
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    texts = rows.select("t_hi", "t_lo", "part", "text")
    led = materialize(_led(nodes), "led")
    nearest = led.groupBy("b").agg(F.min_by("a", F.struct("differ", "a")).alias("a")).select("a", "b")
    edges = materialize(_verified(texts, sketched, nodes, nearest), "verified")
    joined = materialize(components(edges), "joined")
    apart = materialize(_apart(led, joined).select(*_ends("a", "b")).distinct(), "apart")
    edges = edges.unionByName(_joined_in_blocks(texts, sketched, nodes, apart, joined))
    edges, absorbed = _asked(texts, sketched, nodes, edges, absorb)
    roots = materialize(components(edges), "joined")
    of_set = nodes.select("set_hi", "set_lo", "node").join(roots, "node", "left").select("set_hi", "set_lo", "node", F.coalesce("root", "node").alias("root"))
    member = sketched.select("doc_id", "t_hi", "t_lo", "set_hi", "set_lo").join(of_set.drop("node"), ["set_hi", "set_lo"]).drop("set_hi", "set_lo")
    group = member.groupBy("root").agg(F.count("*").alias("n_rows"), F.min("doc_id").alias("kept"))
    if not absorb:
        return materialize(member.join(group.filter("n_rows > 1"), "root").withColumn("top", F.col("root")).drop("n_rows"), "groups"), sketched
    absorbed = _of_final_groups(absorbed, nodes, of_set)
    group = materialize(group.join(_tops(absorbed), "root", "left").withColumn("top", F.coalesce("top", "root")), "tops")
    kept = group.select(F.col("root").alias("top"), "kept")
    touched = group.filter((F.col("n_rows") > 1) | (F.col("top") != F.col("root"))).select("root", "top").join(kept, "top")
    return materialize(member.join(touched, "root"), "groups"), sketched


def _of_final_groups(absorbed: DataFrame, nodes: DataFrame, of_set: DataFrame) -> DataFrame:
    """Absorptions between the final groups, of those whose largest sets are still theirs."""
    size = nodes.select("node", "n").join(of_set.select("node", F.col("root").alias("final")), "node")
    most = size.groupBy("final").agg(F.max("n").alias("most"))
    ends = of_set.select("node", F.col("root").alias("final"))
    here = absorbed.join(ends.select(F.col("node").alias("root"), F.col("final").alias("from_")), "root").join(ends.select(F.col("node").alias("into"), F.col("final").alias("to")), "into")
    here = here.join(most.select(F.col("final").alias("from_"), "most"), "from_").filter(F.col("most") == F.col("q_n"))
    return here.filter("from_ <> to").select(F.col("from_").alias("root"), F.col("to").alias("into"), "n", "tag")


def duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, kept_doc_id) of each row that isn't kept."""
    by_id = grouped(pinned(docs), True)[0].groupBy("root", "top", "doc_id", "kept").agg(F.count("*").alias("n"))
    stays = (F.col("root") == F.col("top")) & F.col("doc_id").eqNullSafe(F.col("kept"))
    return by_id.select("doc_id", F.col("kept").alias("kept_doc_id"), F.explode(F.array_repeat(F.lit(1), (F.col("n") - F.when(stays, 1).otherwise(0)).cast("int"))).alias("one")).drop("one")


def keep_one(docs: DataFrame) -> DataFrame:
    """docs with one row of each group, none absorbed: the columns as they came."""
    docs = pinned(docs)
    group, sketched = grouped(docs, False)
    rows, positions = with_picked(docs, doc_id="bigint", text="string")
    rows = rows.withColumns({"wl_hi": F.xxhash64("wl_text"), "wl_lo": F.xxhash64(F.lit(7), "wl_text"), "wl_part": F.spark_partition_id()})
    marked = rows.withColumn("wl_mark", F.when(F.col("wl_text").isNull(), CLEAR).otherwise(marker(_flags(sketched, group))("wl_hi", "wl_part")))
    alone = marked.filter(F.col("wl_mark") == CLEAR).select(*positions)
    of_text = group.select(F.col("t_hi").alias("wl_hi"), F.col("t_lo").alias("wl_lo"), F.col("root").alias("wl_root")).distinct()
    met = marked.filter(F.col("wl_mark") != CLEAR).join(of_text, ["wl_hi", "wl_lo"], "left")
    first = F.struct(F.col("wl_doc_id").isNull(), "wl_doc_id", "wl_text")
    one = met.filter("wl_root IS NOT NULL").groupBy("wl_root").agg(F.min_by(F.struct(*positions), first).alias("wl_row")).select("wl_row.*")
    return restore(alone.unionByName(met.filter("wl_root IS NULL").select(*positions)).unionByName(one), positions, docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return duplicates(table(spark, sf_dir, "documents"))
