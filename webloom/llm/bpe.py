"""Byte-level BPE encoding and decoding.

A text is split into pre-tokens by the vocabulary's pattern; each pre-token's bytes are merged, lowest rank first and
leftmost among equals, until no pair is in the vocabulary. Merging keeps the bytes in a linked list and the pairs in a
queue by rank: a bucket of list positions for each rank, and a bitmap of two levels over the ranks in which
find-first-set picks the next non-empty bucket. A pair that has changed since it was filed is stale and skipped. So a
pre-token takes about as many steps as it has bytes, however long it is. All new pre-tokens of a batch share one queue,
as separate stretches of the list, and a bucket is merged with array operations.

Results of pre-tokens up to CACHE_CHARS are kept, in two generations of CACHE_ENTRIES, as most pre-tokens recur.

Nulls: a null text has null tokens, count and round trip; an empty text has no tokens. Tokens decode to exactly the
text's UTF-8 bytes. Text that looks like a special token is ordinary text.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.tables import table

from ._cols import pick
from ._text import buffers, chunks

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s+(?!\S)|\s+"
END_OF_DOCUMENT = 50256
CACHE_CHARS = 48
CACHE_ENTRIES = 250_000
WORD = 256  # ranks in a word of the bitmap's lower level
BATCH_BYTES = 6 << 20


class Codec:
    """Encodes and decodes by one vocabulary."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        import regex

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.ranks = ranks
        self.tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            self.tokens[r] = t
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        #: rank of the merged token by (left id, right id)
        pairs = {ranks[t[:i]] << 20 | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.pair_keys = np.sort(np.fromiter(pairs, np.int64, len(pairs)))
        self.pair_ranks = np.array([pairs[k] for k in self.pair_keys.tolist()], np.int64)
        self.split = regex.compile(pattern).findall
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, text: str) -> np.ndarray:
        return np.frombuffer(self.encode_many([text])[0], np.int32)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))

    def encode_many(self, texts: list[str | None]) -> list[bytes | None]:
        """Token ids of each text, as the bytes of 32-bit numbers."""
        split = [None if t is None else self.split(t) for t in texts]
        if len(self.cache) >= CACHE_ENTRIES:
            self.older, self.cache = self.cache, {}
        cache, older, ranks = self.cache, self.older, self.ranks
        new, large = [], []
        for w in set(chain.from_iterable(x for x in split if x)) - cache.keys():
            ids = older.get(w)
            if ids is None:
                raw = w.encode()
                r = ranks.get(raw)
                if r is None:
                    new.append((w, raw))
                    continue
                ids = r.to_bytes(4, "little")
            cache[w] = ids
        for (w, _), ids in zip(new, self.merge_many([raw for _, raw in new])):
            cache[w] = ids
            if len(w) > CACHE_CHARS:
                large.append(w)
        out = [None if x is None else b"".join(map(cache.__getitem__, x)) for x in split]
        for w in large:
            del cache[w]
        return out

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where it isn't one."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], -1)

    def merge_many(self, words: list[bytes]) -> list[bytes]:
        """Token ids of pre-tokens, through one rank queue over all of them, as the bytes of 32-bit numbers.

        Words don't touch, so taking the least rank of all words at once takes each word's ranks in its own order; the
        positions of a rank are merged together, every other one where they overlap (the leftmost first). Should a merge
        make a pair of a lower rank, which a trained vocabulary hardly gives, its word is merged over again by itself."""
        if not words:
            return []
        data = np.frombuffer(b"".join(words), np.uint8)
        n = len(data)
        ends = np.cumsum([len(w) for w in words])
        ids = np.append(self.bytes[data], 0)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        after[ends - 1] = n  # n stands for no successor
        before[np.append(0, ends[:-1])] = -1
        filed = np.full(n + 1, -1)  # the rank that a position's pair is filed under
        filed[: n - 1] = self.rank_of(ids[: n - 1], ids[1:n])
        filed[ends - 1] = -1
        buckets: dict[int, list[np.ndarray]] = {}
        low, top = [0] * (len(self.tokens) // WORD + 1), 0
        there = np.flatnonzero(filed >= 0)
        again: list[np.ndarray] = []
        place, rank = there[np.argsort(filed[there], kind="stable")], np.sort(filed[there])
        while True:
            # file (rank, place), sorted by rank
            if len(rank):
                cuts = np.flatnonzero(rank[1:] != rank[:-1]) + 1
                for r, a, b in zip(rank[np.append(0, cuts)].tolist(), [0, *cuts.tolist()], [*cuts.tolist(), len(rank)]):
                    if r in buckets:
                        buckets[r].append(place[a:b])
                    else:
                        buckets[r] = [place[a:b]]
                        h = r // WORD
                        low[h] |= 1 << r % WORD
                        top |= 1 << h
            if not top:
                break
            h = (top & -top).bit_length() - 1
            bit = low[h] & -low[h]
            r = h * WORD + bit.bit_length() - 1
            low[h] ^= bit
            if not low[h]:
                top &= top - 1
            held = buckets.pop(r)
            i = held[0] if len(held) == 1 else np.unique(np.concatenate(held))
            i = i[filed[i] == r]  # stale ones go
            j = after[i]
            over = i[1:] == j[:-1]
            if over.any():
                begins = np.flatnonzero(np.append(True, ~over))
                since = np.arange(len(i)) - np.repeat(begins, np.diff(np.append(begins, len(i))))
                i, j = i[since % 2 == 0], j[since % 2 == 0]
            k = after[j]
            ids[i] = r
            after[i] = k
            before[k] = i
            filed[j] = -1
            h = before[i]
            h = h[h >= 0]
            left = np.concatenate((h, i))
            right = after[left]
            rank = np.where(right < n, self.rank_of(ids[left], ids[right]), -1)
            filed[left] = rank
            some = rank >= 0
            if (rank[some] < r).any():
                again.append(left[some & (rank < r)])
            order = np.argsort(rank[some], kind="stable")
            place, rank = left[some][order], rank[some][order]
        alive = np.zeros(n + 1, bool)
        at = np.append(0, ends[:-1])
        while len(at):
            alive[at] = True
            at = after[at]
            at = at[at < n]
        flat = ids[:n][alive[:n]].astype(np.int32).tobytes()
        stops = 4 * np.cumsum(alive[:n])[ends - 1]
        out = [flat[a:b] for a, b in zip([0, *stops[:-1].tolist()], stops.tolist())]
        if again:
            for w in np.unique(np.searchsorted(ends, np.concatenate(again), "right")).tolist():
                out[w] = np.array(self.merge(words[w]), np.int32).tobytes()
        return out

    def merge(self, raw: bytes) -> tuple[int, ...]:
        """The same for one pre-token and any vocabulary: one merge at a time, the least rank, then the leftmost."""
        parts = [int(self.bytes[b]) for b in raw]
        while True:
            rank = self.rank_of(np.array(parts[:-1], np.int64), np.array(parts[1:], np.int64))
            if not (rank >= 0).any():
                return tuple(parts)
            i = int(np.where(rank < 0, np.iinfo(np.int64).max, rank).argmin())
            parts[i : i + 2] = [int(rank[i])]


@lru_cache(2)
def codec(path: str = VOCABULARY, pattern: str = PATTERN) -> Codec:
    """The codec of a worker, loaded once."""
    return Codec(path, pattern)


def encode_batch(texts: pa.Array, path: str) -> Iterator[tuple[int, int, list[bytes | None]]]:
    """Row ranges of bounded size with their token ids."""
    for a, b in chunks(texts, BATCH_BYTES):
        yield a, b, codec(path).encode_many(texts.slice(a, b - a).to_pylist())


ENCODED = "doc_id bigint, n_bytes bigint, n_tokens bigint, tokens array<int>, round_trip boolean"


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            for a, b, ids in encode_batch(texts, path):
                c = codec(path)
                raw, off = buffers(texts.slice(a, b - a))
                raw = raw.tobytes()
                none = np.array([x is None for x in ids])
                size = np.array([len(x) // 4 if x else 0 for x in ids], np.int64)
                flat = np.frombuffer(b"".join(x for x in ids if x), np.int32)
                ends = np.concatenate(([0], np.cumsum(size)))
                whole = flat.tolist()
                same = [None if x is None else c.decode(whole[p:q]) == raw[s:t] for x, p, q, s, t in zip(ids, ends[:-1].tolist(), ends[1:].tolist(), off[:-1].tolist(), off[1:].tolist())]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32), mask=np.append(none, False) if none.any() else None), pa.array(flat))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), pa.array(np.diff(off), mask=none), pa.array(size, mask=none), lists, pa.array(same, pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "tokens", "round_trip"],
                )

    return run


def encode(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, tokens, round_trip): round_trip says that the tokens decode to the text's bytes."""
    return pick(docs, doc_id="bigint", text="string").mapInArrow(_encode(path), ENCODED)


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) of (doc_id, tokens); null tokens give null, and bytes that aren't UTF-8 are replaced."""

    @F.arrow_udf("string")
    def text_of(ids: pa.Array) -> pa.Array:
        c = codec(path)
        return pa.array([None if x is None else c.decode(x).decode("utf-8", "replace") for x in ids.to_pylist()], pa.string())

    return pick(encoded, doc_id="bigint", tokens="array<int>").select("doc_id", text_of("tokens").alias("text"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))
