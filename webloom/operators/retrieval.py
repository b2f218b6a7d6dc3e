"""Full-text retrieval: parsing, postings, BM25 with centrality, snippets, merging of several corpora.

search() runs over documents (id, url, host, title, body, centrality). Its plan reads titles and bodies twice at most,
shuffles nothing but one row of corpus statistics, and takes the top k without a global sort; bodies of hits are joined
back to the k ids. search_index() does the same from a postings table, of which it reads only the query's terms.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from webloom.functions.text import lead_snippet, stem, tokens
from webloom.operators.catalog import interleave
from webloom.session import bound_batches

K1, B = 1.2, 0.75
TITLE_BOOST = 2.0
MAX_PAGE, MAX_QUERY, MAX_PEER_HITS = 20, 512, 50
BATCH_POSTINGS = 1 << 16


@dataclass
class Clause:
    words: list[str]
    fields: tuple[str, ...] = ("title", "body")


@dataclass
class Query:
    clauses: list[Clause] = field(default_factory=list)
    hosts: list[str] = field(default_factory=list)

    @property
    def empty(self) -> bool:
        return not self.clauses and not self.hosts

    @property
    def words(self) -> list[str]:
        return list(dict.fromkeys(w for c in self.clauses for w in c.words))


def parse(text: str) -> Query:
    """Words, "phrases", title: and body: prefixes, and site: filters. What doesn't parse is read as words."""
    out, rest = Query(), []
    for word in text[:MAX_QUERY].split():
        if word.startswith("site:") and len(word) > 5:
            out.hosts.append(word[5:].lower().rstrip("/"))
        else:
            rest.append(word)
    for prefix, phrase, word in re.findall(r'(?:(title|body):)?(?:"([^"]*)"|([^\s"]+))', " ".join(rest)):
        words = [w for w in re.split(r"[\W_]+", (phrase or word).lower()) if w]
        if words:
            out.clauses.append(Clause(words, (prefix,) if prefix else ("title", "body")))
    return out


def clamp_page(page: int) -> int:
    return min(max(page, 0), MAX_PAGE)


def _frequency(toks: Column, words: list[str]) -> Column:
    """How often the words follow one another in an array of tokens."""
    if len(words) == 1:
        return F.size(F.filter(toks, lambda t: t == words[0]))
    # one look-ahead for each place, so that overlapping occurrences count; a lambda would read the tokens at each place
    joined = F.concat(F.lit(" "), F.array_join(toks, " "), F.lit(" "))
    return F.regexp_count(joined, F.lit(f"(?= {' '.join(words)} )"))


def _matched(docs: DataFrame, query: Query, stemming: bool) -> tuple[DataFrame, list[tuple[int, str, float]]]:
    fields = {"title": TITLE_BOOST, "body": 1.0}
    words = [[stem(w) if stemming else w for w in c.words] for c in query.clauses]
    terms = [(i, f, fields[f]) for i, c in enumerate(query.clauses) for f in c.fields]
    if stemming:
        return _stem_counts(docs, list(fields), words, [(i, f) for i, f, _ in terms]), terms
    t = docs.select("id", "url", "host", "centrality", *[F.coalesce(tokens(F.col(f)), F.array().cast("array<string>")).alias(f"{f}_t") for f in fields])
    tf = [_frequency(F.col(f"{f}_t"), words[i]).alias(f"tf_{i}_{f}") for i, f, _ in terms]
    return t.select("id", "url", "host", "centrality", *[F.size(f"{f}_t").alias(f"len_{f}") for f in fields], *tf), terms


def _stem_counts(docs: DataFrame, fields: list[str], words: list[list[str]], terms: list[tuple[int, str]]) -> DataFrame:
    """Lengths and frequencies of stems. Words are stemmed and counted document by document, in batches of bounded size, and
    only counts come back; filters on them can't be pushed below, where all texts would be stemmed once more."""
    keep = docs.select("id", "url", "host", "centrality")
    names = [f"len_{f}" for f in fields] + [f"tf_{i}_{f}" for i, f in terms]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, texts = batch.columns[: -len(fields)], batch.columns[-len(fields) :]
            rows = []
            for row in zip(*texts):
                stems = {f: [stem(w) for w in t.as_py().split(" ")] if t.is_valid and t.as_py() else [] for f, t in zip(fields, row)}
                rows.append([len(stems[f]) for f in fields] + [_times(stems[f], words[i]) for i, f in terms])
            counts = [pa.array([r[k] for r in rows], pa.int32()) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays(held + counts, names=[*batch.schema.names[: len(held)], *names])

    bound_batches(docs.sparkSession)
    joined = docs.select(*keep.columns, *[F.array_join(tokens(F.col(f)), " ").alias(f"{f}_t") for f in fields])
    return joined.mapInArrow(run, StructType([*keep.schema, *[StructField(n, IntegerType()) for n in names]]))


def _times(stems: list[str], words: list[str]) -> int:
    """How often the words follow one another, overlaps included."""
    if len(words) == 1:
        return stems.count(words[0])
    return sum(s == words[0] and stems[i : i + len(words)] == words for i, s in enumerate(stems))


def scored(docs: DataFrame, query: Query, weight: float = 0.3, stemming: bool = False) -> DataFrame:
    """(id, url, host, score) of every document that has all clauses and is of the hosts."""
    if query.empty:
        return docs.limit(0).select("id", "url", "host", F.lit(0.0).alias("score"))
    t, terms = _matched(docs, query, stemming)
    if terms:
        stats = [F.count("*").alias("n"), *[F.avg(f"len_{f}").alias(f"avg_{f}") for f in ("title", "body")]]
        stats += [F.count_if(F.col(f"tf_{i}_{f}") > 0).alias(f"df_{i}_{f}") for i, f, _ in terms]
        t = t.crossJoin(F.broadcast(t.agg(*stats)))  # one row
        total = F.lit(0.0)
        for i, f, boost in terms:
            tf, df = F.col(f"tf_{i}_{f}"), F.col(f"df_{i}_{f}")
            idf = F.log1p((F.col("n") - df + 0.5) / (df + 0.5))
            norm = tf + K1 * (1 - B + B * F.col(f"len_{f}") / F.greatest(F.col(f"avg_{f}"), F.lit(1e-9)))
            total = total + F.when(tf > 0, boost * idf * tf * (K1 + 1) / norm).otherwise(0.0)
        has = [reduce(lambda a, b: a | b, [F.col(f"tf_{i}_{f}") > 0 for j, f, _ in terms if j == i]) for i in range(len(query.clauses))]
        t = t.filter(reduce(lambda a, b: a & b, has))
    else:
        total = F.lit(1.0)
    if query.hosts:
        t = t.filter(F.col("host").isin(*query.hosts))
    return t.select("id", "url", "host", (total * (1 + weight * F.coalesce("centrality", F.lit(0.0)))).alias("score"))


def top(scores: DataFrame, page_size: int, page: int = 0) -> DataFrame:
    size = max(page_size, 1)
    return scores.orderBy(F.desc("score"), "url").offset(clamp_page(page) * size).limit(size)


def search(docs: DataFrame, text: str, page_size: int = 10, page: int = 0, weight: float = 0.3, stemming: bool = True) -> DataFrame:
    """(url, host, title, snippet, score) of a page of hits."""
    query = parse(text)
    hits = top(scored(docs, query, weight, stemming), page_size, page)
    body = docs.select("id", "title", "body")
    return hits.join(body, "id").select("url", "host", "title", lead_snippet(F.col("body")).alias("snippet"), "score").orderBy(F.desc("score"), "url")


def total(docs: DataFrame, text: str, stemming: bool = True) -> DataFrame:
    return scored(docs, parse(text), 0.0, stemming).agg(F.count("*").alias("total"))


# The index as tables.
def postings(docs: DataFrame, stemming: bool = False, positions: bool = True) -> DataFrame:
    """(term, field, id, tf, positions) of every term of titles and bodies; without positions where they aren't wanted.

    All words of a document are in its row, so postings are made row by row, without a shuffle. Only those of ids that more
    than one row has are merged; to find these, ids alone are shuffled."""
    repeated = docs.groupBy("id").count().filter("count > 1").select(F.col("id").alias("again"))
    if not repeated.take(1):
        return _row_postings(docs, stemming, positions)
    same = F.col("id").eqNullSafe(F.col("again"))
    merged = [F.sum("tf").alias("tf"), *([F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions")] if positions else [])]
    rest = _row_postings(docs.join(repeated, same, "left_semi"), stemming, positions).groupBy("term", "field", "id").agg(*merged)
    return _row_postings(docs.join(repeated, same, "left_anti"), stemming, positions).unionByName(rest)


def _row_postings(docs: DataFrame, stemming: bool, positions: bool) -> DataFrame:
    """The postings of each row by itself, in batches of about BATCH_POSTINGS."""
    fields = ("title", "body")
    schema = f"term string, field string, id {docs.schema['id'].dataType.simpleString()}, tf bigint" + (", positions array<int>" if positions else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = _Postings(positions)
            for i in range(batch.num_rows):
                for k, f in enumerate(fields):
                    text = batch.column(1 + k)[i].as_py()
                    if text:
                        words = text.split(" ")
                        out.add(i, f, [stem(w) for w in words] if stemming else words)
                if len(out.terms) >= BATCH_POSTINGS:
                    yield out.batch(batch.column(0))
                    out = _Postings(positions)
            yield out.batch(batch.column(0))

    bound_batches(docs.sparkSession)
    return docs.select("id", *[F.array_join(tokens(F.col(f)), " ").alias(f) for f in fields]).mapInArrow(run, schema)


class _Postings:
    """Postings of some rows of a batch, as columns."""

    def __init__(self, positions: bool):
        self.positions, self.terms, self.tf, self.at = positions, [], [], []
        self.rows, self.fields = [], []

    def add(self, row: int, name: str, words: list[str]) -> None:
        if self.positions:
            found: dict[str, list[int]] = {}
            for i, w in enumerate(words):
                found.setdefault(w, []).append(i)
            self.at += found.values()
            self.tf += map(len, found.values())
        else:
            found = Counter(words)
            self.tf += found.values()
        self.terms += found
        self.rows += [row] * len(found)
        self.fields += [name] * len(found)

    def batch(self, ids: pa.Array) -> pa.RecordBatch:
        made = {"term": pa.array(self.terms, pa.string()), "field": pa.array(self.fields, pa.string()), "id": ids.take(pa.array(self.rows, pa.int64())), "tf": pa.array(self.tf, pa.int64())}
        if self.positions:
            made["positions"] = pa.array(self.at, pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays(list(made.values()), names=list(made))


def lengths(docs: DataFrame) -> DataFrame:
    """(field, id, len): a document's tokens by field."""
    return docs.select("id", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.size(tokens(F.col(f))).alias("len")) for f in ("title", "body")])).alias("x")).select("x.field", "id", "x.len")


def term_stats(postings_: DataFrame) -> DataFrame:
    return postings_.groupBy("term", "field").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def write_index(docs: DataFrame, path: str, buckets: int = 64, stemming: bool = True) -> None:
    """Postings by hash of the term, so that a query opens only its terms' partitions; and lengths."""
    p = postings(docs, stemming).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    p.repartition("bucket").sortWithinPartitions("term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    lengths(docs).write.mode("overwrite").parquet(f"{path}/lengths")


def search_index(index: str, docs: DataFrame, words: list[str], page_size: int = 10, buckets: int = 64, weight: float = 0.3, stemming: bool = True) -> DataFrame:
    """(url, score) of the documents that have all the words, from the tables of write_index()."""
    spark = docs.sparkSession
    wanted = sorted({stem(w) if stemming else w for w in words})
    want = spark.range(1).select(F.explode(F.array(*map(F.lit, wanted))).alias("term")).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    places = sorted({r.bucket for r in want.collect()})
    p = spark.read.parquet(f"{index}/postings").filter(F.col("bucket").isin(*places) & F.col("term").isin(*wanted)).select("term", "field", "id", "tf")
    length = spark.read.parquet(f"{index}/lengths")
    stats = length.groupBy("field").agg(F.count("*").alias("n"), F.avg("len").alias("avg"))
    df = p.groupBy("term", "field").agg(F.count("*").alias("df"))
    s = p.join(df, ["term", "field"]).join(length, ["field", "id"]).join(stats, "field")
    idf = F.log1p((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.when(F.col("field") == "title", TITLE_BOOST).otherwise(1.0) * idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avg")))
    whole = s.withColumn("part", part).groupBy("id").agg(F.sum("part").alias("score"), F.countDistinct("term").alias("have")).filter(F.col("have") == len(wanted))
    hits = whole.join(docs.select("id", "url", "centrality"), "id")
    return top(hits.select("url", (F.col("score") * (1 + weight * F.coalesce("centrality", F.lit(0.0)))).alias("score")), page_size)


def peer_hits(hits: DataFrame, badge: str, list_idx: int) -> DataFrame:
    """What a peer sends, as hits of ours: the host from the URL, no fetch time, the peer's badge; MAX_PEER_HITS at most."""
    from webloom.functions.url import host_of

    best = hits.orderBy(F.desc("score"), "url").limit(MAX_PEER_HITS)
    return best.select("url", host_of(F.col("url")).alias("host"), "title", "snippet", "score", F.lit(0).cast("bigint").alias("fetched_at"), F.lit(badge).alias("source"), F.lit(list_idx).alias("list_idx"))


def federate(lists: list[DataFrame], page_size: int) -> DataFrame:
    """Hits (list_idx, pos, url, ...) of several corpora, ours first, in turn."""
    return interleave(reduce(DataFrame.unionByName, lists), page_size)
