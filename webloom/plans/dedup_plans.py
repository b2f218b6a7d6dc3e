"""Duplicate gates with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from webloom.functions.hashing import sha256
from webloom.operators import dedup as D
from webloom.plans.fixtures import sql, view
from webloom.session import materialize

BITS = r"""WITH w AS (SELECT id, unnest(string_split(lower(trim(regexp_replace(body, '\s+', ' ', 'g'))), ' ')) AS w FROM corpus), c AS (SELECT id, md5(w) AS h, count(*) AS n FROM w WHERE w <> '' GROUP BY ALL),
b AS (SELECT id, i, sum(CASE WHEN (CAST('0x' || h[1 + i // 4] AS INT) >> (3 - i % 4)) & 1 = 1 THEN n ELSE -n END) AS v FROM c, range(64) r(i) GROUP BY ALL),
s AS (SELECT id, string_agg(CASE WHEN v > 0 THEN '1' ELSE '0' END, '' ORDER BY i) AS bits FROM b GROUP BY id)"""
FOLD = "(SELECT CAST(sum(CASE WHEN bits[i + 1] = '1' THEN (CASE WHEN i = 0 THEN -9223372036854775808::HUGEINT ELSE 1::HUGEINT << (63 - i) END) ELSE 0 END) AS BIGINT) FROM range(64) q(i))"


def _hashes(s, d):
    return D.simhash(view(s, d, "corpus").select("id", F.col("body").alias("text")))


def _held(s, d):
    """The same, written out: plans that use the hashes twice would read all texts twice."""
    return materialize(_hashes(s, d), "hashes")


def _gate(s, d):
    docs = view(s, d, "corpus")
    return D.gate_duplicates(docs.select("id", sha256(F.col("body")).alias("sha256")).join(_hashes(s, d), "id"))


DEDUP = {
    "sha_exact_dup": (
        lambda s, d: view(s, d, "corpus").select("id", sha256(F.col("body")).alias("sha256")).select("id", D.exact_first().alias("first")),
        sql("SELECT id, row_number() OVER (PARTITION BY sha256(body) ORDER BY id) = 1 AS first FROM corpus"),
    ),
    "simhash_bits": (_hashes, sql(f"{BITS} SELECT id, {FOLD} AS simhash FROM s")),
    "near_dup_pairs": (
        lambda s, d: D.near_pairs(_held(s, d)),
        sql(f"{BITS}, v AS (SELECT h, min(id) AS id FROM (SELECT id, {FOLD} AS h FROM s) GROUP BY h) SELECT least(x.id, y.id) AS a, greatest(x.id, y.id) AS b FROM v x JOIN v y ON x.id < y.id AND bit_count(xor(x.h, y.h)) <= 3"),
    ),
    "simhash_classes": (
        lambda s, d: D.classes(_held(s, d)),
        sql(f"{BITS}, v AS (SELECT id, {FOLD} AS h FROM s) SELECT id, min(id) OVER (PARTITION BY h) AS first FROM v"),
    ),
    "near_dup_greedy": (_gate, None),
}
