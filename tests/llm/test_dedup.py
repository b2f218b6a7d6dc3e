"""Exact and near duplicates against brute force."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.conftest import SF
from tests.llm import util
from webloom.llm import containment as C
from webloom.llm import golomb_dedup as G
from webloom.llm._aligned import pinned
from webloom.llm._text import shingle_sets


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**G.FP_BITS - 1), max_size=300))
def test_rice_round_trip(values):
    v = np.sort(np.array(values, np.uint64))
    assert (G.rice_decode(G.rice_encode(v)) == v).all()


def brute_exact(data):
    by_text = {}
    for r in data:
        if r[1] is not None:
            by_text.setdefault(r[1], []).append(r[0])
    out = []
    for ids in by_text.values():
        ids.sort(key=lambda x: (x is None, x or 0))
        out += [(i, ids[0]) for i in ids[1:]]
    return sorted(out, key=repr)


@pytest.mark.parametrize("make", [util.edge, util.clashing, util.empty])
def test_exact_edges(spark, make):
    df = make(spark)
    data = [(r["doc_id"], r[1]) for r in df.collect()]
    assert util.rows(G.duplicates(df)) == brute_exact(data)
    kept = G.keep_first(df)
    assert kept.columns == df.columns
    texts = [r[1] for r in kept.collect()]
    assert sorted(t for t in texts if t is not None) == sorted({t for _, t in data if t is not None})
    assert texts.count(None) == sum(t is None for _, t in data)


def test_exact_whole_table_and_union(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    assert pinned(df) is df and pinned(df.repartition(3)) is not df
    want = brute_exact([(r.doc_id, r.text) for r in df.collect()])
    assert util.rows(G.duplicates(df)) == want
    once = G.keep_first(df)
    assert once.union(G.keep_first(df.repartition(5))).count() == 2 * (df.count() - len(want))


def components(pairs, n):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    return [find(i) for i in range(n)]


def brute_near(data):
    """(joining pairs, group of each row) by comparing all pairs of shingle sets."""
    sets = shingle_sets(pa.array([t for _, t in data], pa.string()), C.SHINGLE)
    pairs = [(i, j) for j in range(len(data)) for i in range(j) if len(sets[i]) and len(sets[j]) and C.joins(sets[i], sets[j])]
    return pairs, components(pairs, len(data))


def brute_tops(data, root):
    """Of each row, the groups that may stay for it: its own, or those at the end of any way of absorptions."""
    sets = shingle_sets(pa.array([t for _, t in data], pa.string()), C.SHINGLE)
    most, into = {}, {}
    for i, r in enumerate(root):
        most[r] = max(most.get(r, 0), len(sets[i]))
    for i, r in enumerate(root):
        if len(sets[i]) == most[r] and len(sets[i]):
            into.setdefault(r, set()).update(root[j] for j in range(len(data)) if len(sets[j]) > C.RATIO * len(sets[i]) and C.near(sets[i], sets[j]))
    return [ends(into, r) for r in root], {r for r in into if into[r]}


def ends(into, r):
    return set().union(*(ends(into, x) for x in into[r])) if into.get(r) else {r}


def check_duplicates(df, data):
    """data sorted by doc_id. Which rows go must be exact; what stays for them must be at the end of a way."""
    _, root = brute_near(data)
    tops, absorbed = brute_tops(data, root)
    got = sorted((tuple(r) for r in C.duplicates(df).collect()), key=repr)
    gone = [data[i][0] for i, r in enumerate(root) if r != i or r in absorbed]
    assert sorted((x for x, _ in got), key=repr) == sorted(gone, key=repr)
    may = {}
    for i, r in enumerate(root):
        if r != i or r in absorbed:
            may.setdefault(data[i][0], set()).update(data[t][0] for t in tops[i])
    assert all(kept in may[x] for x, kept in got)
    return root


@pytest.mark.parametrize("make", [util.edge, util.clashing, util.empty])
def test_near_edges(spark, make):
    df = make(spark)
    data = sorted(((r["doc_id"], r[1]) for r in df.collect()), key=lambda x: (x[0] is None, x[0] or 0))
    root = check_duplicates(df, data)
    kept = C.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=repr) == sorted((data[i][0] for i, r in enumerate(root) if r == i), key=repr)


def test_near_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    check_duplicates(df, sorted((r.doc_id, r.text) for r in df.collect()))


def test_shingles_of_few_words():
    a, b, c, d = shingle_sets(pa.array(["x y", "X, y!", "", None]), 4)
    assert len(a) == 1 and (a == b).all() and not len(c) and not len(d)


def test_tuning():
    assert C.least_jaccard(0) == 1.0
    for c in range(20):
        s, (bands, rows) = C.least_jaccard(c), C.banding(c)
        assert bands * rows <= C.HASHES and 1 - (1 - s**rows) ** bands >= C.RECALL


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 200), (200, 150)], "a bigint, b bigint")
    got = dict(C.components(edges).collect())
    assert {got[i] for i in range(41)} == {0} and got[150] == got[200] == got[100] == 100
    assert C.components(edges.limit(0)).count() == 0


def hot(n: int = 300) -> list[tuple[int, str]]:
    """Texts of mixed lengths that share a passage: many are near, many aren't."""
    import random

    r = random.Random(7)
    shared = " ".join(f"hot{i}" for i in range(60))
    return [(i, shared + "".join(f" own{i}x{j}" for j in range(r.randint(15, 69)))) for i in range(n)]


def test_near_in_a_hot_bucket(spark):
    data = hot()
    check_duplicates(spark.createDataFrame(data, "doc_id bigint, text string"), data)


def test_near_holds_whole_texts_of_any_length(spark):
    data = [(1, util.prose(50, 40)), (2, util.prose(51, 4)), (3, util.prose(52, 300))]
    data += [(10 + i, t + " " + util.prose(60 + i, n)) for i, ((_, t), n) in enumerate(zip(data, (30, 9_000, 1_200)))]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    assert util.rows(C.duplicates(df)) == [(1, 10), (2, 11), (3, 12)]
    assert C.keep_one(df).count() == 6


def test_quotes_of_one_text_are_not_joined(spark):
    """100 texts, each held whole in one twice as long; one short text held in all of these; a chain of containers."""
    quoted = util.prose(70, 12)
    data = [(i, util.prose(100 + i, 60)) for i in range(100)]
    data += [(1000 + i, t + " " + util.prose(300 + i, 60) + " " + quoted) for i, t in data]
    data += [(2000, quoted), (3000, data[100][1] + " " + util.prose(71, 400)), (3001, data[100][1] + " " + util.prose(72, 900))]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    check_duplicates(df, sorted(data))
    got = dict(tuple(r) for r in C.duplicates(df).collect())
    assert set(got) == {*range(100), 1000, 2000} and all(got[i] == 1000 + i for i in range(1, 100))
    assert got[0] == got[1000] == 3001 and C.keep_one(df).count() == len(data)


def test_near_at_the_threshold(spark):
    """Pairs whose containment is just enough, of equal and of different sizes: at least 0.95 are found."""
    import random

    r, data = random.Random(3), []
    for i in range(200):
        words = [f"w{i}x{j}" for j in range(203)]  # 200 shingles
        data.append((2 * i, " ".join(words)))
        cut = r.randint(0, 60)
        extra = (0, 80, 260, 1500)[i % 4]
        data.append((2 * i + 1, " ".join(words[cut : cut + 143] + [f"y{i}x{j}" for j in range(60 + extra)])))  # 140 shared
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    gone = {x for x, _ in C.duplicates(df).collect()}
    assert sum(2 * i in gone or 2 * i + 1 in gone for i in range(200)) >= 190


def test_sketches_pass_pairs_at_the_least_similarity():
    from math import comb

    for c in range(20):
        p = (1 - C.least_jaccard(c)) / 2
        assert sum(comb(128, k) * p**k * (1 - p) ** (128 - k) for k in range(C.sketch_distance(c) + 1)) >= 0.999


def seen_rows(monkeypatch):
    """What is materialized from here on: the most rows by tag."""
    rows, write = {}, C.materialize

    def record(df, tag, *rest):
        out = write(df, tag, *rest)
        rows[tag] = max(rows.get(tag, 0), out.count())
        return out

    monkeypatch.setattr(C, "materialize", record)
    return rows


def test_edited_copies_are_not_verified_by_pair(spark, monkeypatch):
    """Copies with many edits, so that pairs lie about the threshold: what is verified by pair stays near the number of texts."""
    import random

    r = random.Random(11)
    words = [f"c{j}" for j in range(300)]
    data = [(i, " ".join(f"e{i}x{j}" if r.random() < rate else w for j, w in enumerate(words))) for i in range(240) for rate in [r.uniform(0.04, 0.09)]]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    rows = seen_rows(monkeypatch)
    kept = C.keep_one(df).count()
    assert rows["apart"] <= 8 * len(data)
    _, root = brute_near(data)
    assert len(set(root)) <= kept <= len(set(root)) + 3  # links at the least containment may be missed


def test_a_passage_that_many_hold_makes_no_pairs(spark, monkeypatch):
    """A passage of just over half of each short text, held by many long ones: no long text is a container."""
    passage = util.prose(80, 58)
    data = [(i, util.prose(500 + i, 25) + " " + passage + " " + util.prose(700 + i, 20)) for i in range(60)]
    data += [(100 + i, util.prose(900 + i, 150) + " " + passage + " " + util.prose(1100 + i, 150)) for i in range(60)]
    data += [(200, data[0][1] + " " + util.prose(81, 90))]
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    rows = seen_rows(monkeypatch)
    assert [tuple(x) for x in C.duplicates(df).collect()] == [(0, 200)]
    assert rows["likely"] <= len(data)


def test_blocks_join_what_pairs_would(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_ROWS", 7)
    data = hot(90)
    docs = spark.createDataFrame(data, "doc_id bigint, text string").coalesce(1)
    rows = pinned(docs).selectExpr("doc_id AS node", "text", "xxhash64(text) AS t_hi", "xxhash64(7, text) AS t_lo", "spark_partition_id() AS part")
    nodes = C.materialize(rows.selectExpr("node", "t_hi", "t_lo", "size(split(text, ' ')) - 3 AS n", "part"), "nodes")
    pairs = C.materialize(nodes.select(nodes.node.alias("a")).crossJoin(nodes.select(nodes.node.alias("b"))).filter("a < b"), "pairs")
    roots = spark.createDataFrame([(0, 0), (1, 0)], "node bigint, root bigint")
    got = [tuple(x) for x in C._joined_in_blocks(rows, nodes, nodes, pairs, roots).collect()]
    links, root = brute_near(data)
    assert set(got) <= set(links) and len(got) < len(links)
    assert components([*got, (0, 1)], len(data)) == components([*links, (0, 1)], len(data))
