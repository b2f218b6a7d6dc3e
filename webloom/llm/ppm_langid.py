"""Language identification by prediction by partial matching.

For each language a context tree of byte contexts up to ORDER is counted over a bounded sample of labelled rows and
then frozen. The code length of a byte is -log2 of its probability after the longest context seen; after an escape
(method C: d of T + d, for d distinct successors in T) the next shorter context codes it, and below order 0 it costs
8 bits. A text's code length under a language is the exact sum over all its bytes; the language with the least wins,
ties going to the first by name.

As statistics are frozen, a byte's cost is a function of the ORDER + 1 bytes that end in it. So the trees of all
languages become one dictionary of seen grams with a cost for each language, and one of contexts with their escape
costs; unseen grams add the escape cost and go on one order lower. Scoring is a few array lookups for each byte.

A text is rejected (accepted = false) if it is null or has no letter, or if its best code length is over MAX_BITS a
byte, the size of the bytes themselves, for at least MIN_BYTES bytes: no language then explains it. Empty texts and nulls have a null language. Without
any labelled row there is nothing to tell languages by: all have a null language, and texts with letters are accepted.
Labels other than null and '' count as languages as they are. Repeated rows get equal results.

The sample is the rows with the least hash of a language, up to SAMPLE_ROWS rows and SAMPLE_BYTES bytes (one row at
least), of every label; it bounds the training, not the scoring. Languages are trained and scored BLOCK at a time, so
that costs are stored for the grams of BLOCK languages only and memory grows in proportion to the languages.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webloom.session import bound_batches
from webloom.tables import table

from ._cols import pick, restore, with_picked
from ._text import buffers, chunks

ORDER = 4
SAMPLE_ROWS = 384
SAMPLE_BYTES = 2_000_000
BLOCK = 16  # languages that share a dictionary
MAX_BITS = 8.0
MIN_BYTES = 24
STRETCH = 1 << 17  # bytes of texts, or of a long text, scored at a time
PAD = 10  # a text begins as if after line ends

RESULT = "lang string, bits_per_byte double, margin double, accepted boolean"


class Table:
    """Open-addressing map from integer keys to row numbers, looked up by arrays."""

    def __init__(self, keys: np.ndarray):
        self.bits = max(4, int(len(keys)).bit_length() + 2)
        self.keys = np.full(1 << self.bits, np.iinfo(np.uint64).max, np.uint64)
        self.rows = np.full(1 << self.bits, -1, np.int32)
        left = np.arange(len(keys))
        at = self.slot(keys)
        while len(left):
            free = self.rows[at] < 0
            self.rows[at[free]] = left[free]
            self.keys[at[free]] = keys[left[free]]
            lost = self.rows[at] != left
            # a slot's key must be that of the row that won it
            self.keys[at] = keys[self.rows[at]]
            left, at = left[lost], (at[lost] + 1) & ((1 << self.bits) - 1)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row numbers, -1 where unseen."""
        at = self.slot(keys)
        out = self.rows[at]
        open_ = np.flatnonzero((self.keys[at] != keys) & (out >= 0))
        while len(open_):
            at_open = (at[open_] + 1) & ((1 << self.bits) - 1)
            at[open_] = at_open
            out[open_] = self.rows[at_open]
            open_ = open_[(self.keys[at_open] != keys[open_]) & (out[open_] >= 0)]
        return out


def _grams(data: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """Key of the length bytes that end at each byte, PAD before the beginning of a text."""
    key = np.zeros(len(data), np.uint64)
    n = len(data)
    since = np.arange(n) - np.repeat(starts, np.diff(np.append(starts, n))) if length > 1 and n else None
    for back in range(length - 1, -1, -1):
        b = np.full(n, PAD, np.uint64)
        if back == 0:
            b[:] = data
        elif n > back:
            b[back:] = data[:-back]
            b[since < back] = PAD
        key = (key << np.uint64(8)) | b
    return key


@dataclass
class Model:
    languages: list[str]
    grams: list[Table]  # by order, of the keys of order + 1 bytes
    costs: list[np.ndarray]  # rows x languages
    contexts: list[Table | None]
    escapes: list[np.ndarray]

    def byte_costs(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Bits of each byte under each language."""
        full = _grams(data, starts, ORDER + 1)
        cost = np.zeros((len(data), len(self.languages)), np.float32)
        left: np.ndarray | None = None
        for order in range(ORDER, -1, -1):
            keys = full if left is None else full[left]
            if order < ORDER:
                keys = keys & np.uint64((1 << (8 * (order + 1))) - 1)
            row = self.grams[order].find(keys)
            hit = row >= 0
            if left is None:
                cost = self.costs[order][np.maximum(row, 0)]
                left = np.flatnonzero(~hit)
                cost[left] = 0
            else:
                cost[left[hit]] += self.costs[order][row[hit]]
                left = left[~hit]
            if not len(left):
                return cost
            if order:
                before = (full[left] >> np.uint64(8)) & np.uint64((1 << (8 * order)) - 1)
                row = self.contexts[order].find(before)
                seen = row >= 0
                cost[left[seen]] += self.escapes[order][row[seen]]
            else:
                cost[left] += self.escapes[0] + np.float32(8)
        return cost

    def totals(self, arr: pa.Array) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(arr), len(self.languages)))
        for a, b in chunks(arr, STRETCH):
            data, off = buffers(arr.slice(a, b - a))
            full = off[1:] > off[:-1]
            if not full.any():
                continue
            if b - a == 1:  # perhaps a long text: by stretches, each after the bytes before it
                for at in range(0, len(data), STRETCH):
                    before = min(at, ORDER)
                    out[a] += self.byte_costs(data[at - before : at + STRETCH], np.zeros(1, np.int64))[before:].sum(0, dtype=np.float64)
                continue
            cost = self.byte_costs(data, off[:-1][full])
            out[a:b][full] = np.add.reduceat(cost, off[:-1][full], axis=0, dtype=np.float64)
        return out


def train(texts: dict[str, list[bytes]]) -> Model | None:
    """Trees counted over texts by language, with every cost resolved."""
    languages = sorted(texts)
    if not languages:
        return None
    n = len(languages)
    streams = []
    for name in languages:
        parts = [t for t in texts[name] if t]
        data = np.frombuffer(b"".join(parts), np.uint8)
        streams.append((data, np.cumsum([0] + [len(p) for p in parts[:-1]]) if parts else np.zeros(0, np.int64)))
    grams, costs, contexts, escapes = [], [], [], []
    for order in range(ORDER + 1):
        keyed = [np.unique(_grams(d, s, order + 1), return_counts=True) for d, s in streams]
        keys = np.unique(np.concatenate([k for k, _ in keyed]))
        before = np.unique(keys >> np.uint64(8))
        esc = np.zeros((len(before), n))
        cost = np.zeros((len(keys), n))
        for i, (k, c) in enumerate(keyed):
            ctx, inverse, distinct = np.unique(k >> np.uint64(8), return_inverse=True, return_counts=True)
            total = np.bincount(inverse, c, len(ctx)) + distinct
            place = np.searchsorted(before, ctx)
            esc[place, i] = -np.log2(distinct / total) if len(ctx) else 0
            if order:
                shorter = grams[order - 1].find(keys & np.uint64((1 << (8 * order)) - 1))
                cost[:, i] = costs[order - 1][shorter, i]
            else:
                cost[:, i] = 8
            cost[:, i] += esc[np.searchsorted(before, keys >> np.uint64(8)), i]
            at = np.searchsorted(keys, k)
            cost[at, i] = -np.log2(c / total[inverse]) if len(k) else 0
        grams.append(Table(keys))
        costs.append(cost.astype(np.float32))
        contexts.append(Table(before) if order else None)
        escapes.append((esc if order else esc[0] if len(esc) else np.zeros(n)).astype(np.float32))
    return Model(languages, grams, costs, contexts, escapes)


@dataclass
class Models:
    """Models of some languages each, in order of their names."""

    blocks: list[Model]

    @property
    def languages(self) -> list[str]:
        return [name for m in self.blocks for name in m.languages]

    def totals(self, arr: pa.Array) -> np.ndarray:
        return np.hstack([m.totals(arr) for m in self.blocks])


def train_all(texts: dict[str, list[bytes]]) -> Models | None:
    names = sorted(texts)
    blocks = [train({name: texts[name] for name in names[i : i + BLOCK]}) for i in range(0, len(names), BLOCK)]
    return Models(blocks) if blocks else None


def sample(docs: DataFrame) -> dict[str, list[bytes]]:
    rows = pick(docs, doc_id="bigint", text="string", lang="string").filter("text <> '' AND lang <> ''")
    rows = rows.withColumn("h", F.xxhash64("doc_id", "text"))
    w = Window.partitionBy("lang").orderBy("h")
    least = rows.select("lang", "h", F.octet_length("text").alias("size")).withColumn("n", F.row_number().over(w)).filter(F.col("n") <= SAMPLE_ROWS)
    least = least.withColumn("sum", F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0))).filter(f"n = 1 OR sum <= {SAMPLE_BYTES}")
    wanted = least.select("lang", "h").distinct()  # at most SAMPLE_ROWS a language, whatever the input
    got: dict[str, dict[int, bytes]] = {}
    for r in rows.join(F.broadcast(wanted), ["lang", "h"], "left_semi").select("lang", "h", F.encode("text", "utf-8").alias("b")).toLocalIterator():
        got.setdefault(r.lang, {})[r.h] = bytes(r.b)
    return {lang: [by[h] for h in sorted(by)] for lang, by in got.items()}


def judge(model: Model | Models | None, arr: pa.Array) -> pa.StructArray:
    import pyarrow.compute as pc

    size = pc.fill_null(pc.binary_length(arr), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    lettered = pc.fill_null(pc.match_substring_regex(arr, r"\pL"), False).to_numpy(zero_copy_only=False)
    n = len(arr)
    if model is None or not n:
        return pa.StructArray.from_arrays([pa.nulls(n, pa.string()), pa.nulls(n, pa.float64()), pa.nulls(n, pa.float64()), pa.array(lettered, pa.bool_())], ["lang", "bits_per_byte", "margin", "accepted"])
    bits = model.totals(arr) / np.maximum(size, 1)[:, None]
    best = bits.argmin(1)
    least = bits[np.arange(n), best]
    second = np.partition(bits, 1, axis=1)[:, 1] if bits.shape[1] > 1 else least
    none = size == 0
    ok = lettered & ~((least > MAX_BITS) & (size >= MIN_BYTES))
    names = np.array(model.languages, object)[best]
    return pa.StructArray.from_arrays(
        [pa.array(names, pa.string(), mask=none), pa.array(least, mask=none), pa.array(second - least, mask=none), pa.array(ok, pa.bool_())],
        ["lang", "bits_per_byte", "margin", "accepted"],
    )


def scorer(docs: DataFrame) -> "Column":
    """A function of a text column, with the model trained on docs."""
    bound_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(train_all(sample(docs)))

    @F.arrow_udf(RESULT)
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = held.value
        for arr in batches:
            yield judge(model, arr)

    return score


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, bits_per_byte, margin, accepted) of every row."""
    rows = pick(docs, doc_id="bigint", text="string")
    return rows.select("doc_id", scorer(docs)("text").alias("r")).select("doc_id", "r.*")


def keep_accepted(docs: DataFrame) -> DataFrame:
    """docs without the rejected rows, the columns as they came."""
    rows, positions = with_picked(docs, text="string")
    return restore(rows.filter(scorer(docs)("wl_text")["accepted"]), positions, docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
