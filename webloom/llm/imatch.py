"""Document fingerprints by I-Match.

A term's document frequency is counted over all documents. The lexicon is the terms whose inverse document frequency
lies in a band: found in at most one of COMMON documents, in at least one of RARE, and in MIN_DF or more. A document's
distinct lexicon terms are sorted, joined by spaces and hashed (MD5); so again for each of SUBSETS random subsets of
the lexicon, which keep a term if the first hex digit of MD5(subset:term) is less than KEEP_BELOW. Documents that share
a fingerprint have the same informative terms; the subsets forgive a term more or less.

A term is a run of ASCII letters, digits and non-ASCII characters of the lower-cased text. As a lexicon term is in at
least a RAREth of the documents, the lexicon has at most RARE times as many terms as a document has on average, however
many documents there are. Its size is checked all the same: beyond MAX_BROADCAST terms, terms are joined with it.

Nulls: a null text counts for nothing and has null fingerprints and 0 terms, as has a text without lexicon terms (a
fingerprint over no term of a subset is null too). Rows with equal texts have equal fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.session import materialize
from webloom.tables import table

from ._cols import pick
from ._text import chunks

COMMON = 20
RARE = 2000
MIN_DF = 2
SUBSETS = 4
KEEP_BELOW = "c"
MAX_BROADCAST = 3_000_000

TERM = r"[0-9a-z\x{80}-\x{10FFFF}]+"

SQL = f"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, list_distinct(regexp_extract_all(lower(text), '{TERM}')) AS terms FROM documents
), t AS (SELECT r, unnest(terms) AS term FROM d),
n AS (SELECT count(*) AS n FROM documents WHERE text IS NOT NULL),
lexicon AS (
  SELECT term FROM t, n GROUP BY term, n HAVING count(*) * {COMMON} <= n AND count(*) * {RARE} >= n AND count(*) >= {MIN_DF}
), f AS (
  SELECT r, count(*) AS n_terms, md5(string_agg(term, ' ' ORDER BY term)) AS fp_0,
  {", ".join(f"md5(string_agg(term, ' ' ORDER BY term) FILTER (md5('{k}:' || term)[1] < '{KEEP_BELOW}')) AS fp_{k}" for k in range(1, SUBSETS + 1))}
  FROM t JOIN lexicon USING (term) GROUP BY r
)
SELECT doc_id, coalesce(n_terms, 0) AS n_terms, {", ".join(f"fp_{k}" for k in range(SUBSETS + 1))} FROM d LEFT JOIN f USING (r)
"""

FINGERPRINTS = ["n_terms bigint", *[f"fp_{k} string" for k in range(SUBSETS + 1)]]


def _terms(arr: pa.Array) -> Iterator[list[str]]:
    """The distinct terms of each text, unordered."""
    plain = pc.replace_substring_regex(pc.fill_null(pc.utf8_lower(arr), ""), rf"[^0-9a-z\x{{80}}-\x{{10FFFF}}]+", " ")
    for text in plain.to_pylist():
        yield set(text.split(" ")) - {""}


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Document frequencies of a partition, let go whenever they grow large."""
    df: dict[str, int] = {}

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(df.keys(), pa.string()), pa.array(df.values(), pa.int64())], ["term", "df"])

    for batch in batches:
        texts = batch.column(0)
        for a, b in chunks(texts):
            for terms in _terms(texts.slice(a, b - a)):
                for t in terms:
                    df[t] = df.get(t, 0) + 1
            if len(df) > 400_000:
                yield out()
                df.clear()
    if df:
        yield out()


def lexicon(docs: DataFrame) -> DataFrame:
    """The terms of the band."""
    texts = pick(docs, text="string").filter("text IS NOT NULL")
    n = texts.count()
    df = texts.mapInArrow(_count, "term string, df bigint").groupBy("term").agg(F.sum("df").alias("df"))
    return df.filter((F.col("df") * COMMON <= n) & (F.col("df") * RARE >= n) & (F.col("df") >= MIN_DF)).select("term")


def _masks(terms: list[str]) -> dict[str, int]:
    """Bit k set: subset k keeps the term; subset 0 is the whole lexicon."""
    return {t: 1 + sum((md5(f"{k}:{t}".encode()).hexdigest()[0] < KEEP_BELOW) << k for k in range(1, SUBSETS + 1)) for t in terms}


def _hash(terms: list[str]) -> str | None:
    return md5(" ".join(terms).encode()).hexdigest() if terms else None


def _by_broadcast(rows: DataFrame, terms: list[str]) -> DataFrame:
    held = rows.sparkSession.sparkContext.broadcast(_masks(terms))

    @F.arrow_udf("struct<" + ",".join(x.replace(" ", ":") for x in FINGERPRINTS) + ">")
    def fingerprint(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        masks = held.value
        known = masks.keys()
        for arr in batches:
            counts, columns = [], [[] for _ in range(SUBSETS + 1)]
            for a, b in chunks(arr):
                for terms in _terms(arr.slice(a, b - a)):
                    mine = sorted(terms & known, key=lambda t: t.encode())
                    counts.append(len(mine))
                    for k, column in enumerate(columns):
                        column.append(_hash([t for t in mine if masks[t] >> k & 1]))
            yield pa.StructArray.from_arrays([pa.array(counts, pa.int64()), *[pa.array(c, pa.string()) for c in columns]], [x.split()[0] for x in FINGERPRINTS])

    return rows.select("doc_id", fingerprint("text").alias("f")).select("doc_id", "f.*")


def _by_join(rows: DataFrame, lexicon_: DataFrame) -> DataFrame:
    """Without a broadcast: terms of all texts joined with the lexicon and gathered again by row."""
    rows = materialize(rows.withColumn("r", F.monotonically_increasing_id()), "imatch")
    term = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(TERM), F.lit(0)))).alias("term")
    kept = rows.select("r", term).join(lexicon_, "term")
    lists = [F.sort_array(F.collect_list(F.when(F.substring(F.md5(F.concat(F.lit(f"{k}:"), "term")), 1, 1) < KEEP_BELOW, F.col("term")) if k else F.col("term"))) for k in range(SUBSETS + 1)]
    prints = kept.groupBy("r").agg(F.count("*").alias("n_terms"), *[F.when(F.size(x) > 0, F.md5(F.array_join(x, " "))).alias(f"fp_{k}") for k, x in enumerate(lists)])
    return rows.select("r", "doc_id").join(prints, "r", "left").withColumn("n_terms", F.coalesce("n_terms", F.lit(0))).drop("r")


def fingerprints(docs: DataFrame, max_broadcast: int = MAX_BROADCAST) -> DataFrame:
    """(doc_id, n_terms, fp_0 .. fp_SUBSETS) of every row."""
    rows = pick(docs, doc_id="bigint", text="string")
    terms = materialize(lexicon(docs), "lexicon")
    if terms.count() > max_broadcast:
        return _by_join(rows, terms)
    return _by_broadcast(rows, [t for (t,) in terms.toLocalIterator()])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(table(spark, sf_dir, "documents"))
