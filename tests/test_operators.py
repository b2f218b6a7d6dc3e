"""Operators against plain models: merges, windows, greedy duplicates, graphs, search, streams."""

from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF
from webloom.functions.url import host_of
from webloom.operators import catalog as C
from webloom.operators import dedup as D
from webloom.operators import graph as G
from webloom.operators import retrieval as R
from webloom.plans.dedup_plans import DEDUP
from webloom.streaming import outcomes as O
from webloom.streaming import scheduler as S


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


@pytest.mark.parametrize("seed", range(2))
def test_newest_wins(spark, seed):
    r = random.Random(seed)
    rows = [(f"u{r.randint(0, 20)}", i, r.randint(0, 3), r.choice("ab")) for i in range(300)]
    current, accepted = {}, []
    for url, i, at, sha in rows:
        now = current.get(url)
        if now and (at < now[1] or (at == now[1] and sha == now[2])):
            continue
        current[url] = (i, at, sha)
        accepted.append(i)
    df = spark.createDataFrame(rows, "url string, arrival bigint, fetched_at bigint, sha256 string").repartition(3)
    assert ids(C.accepted_at_arrival(df), "arrival") == accepted
    assert ids(C.newest_snapshot(df), "arrival") == sorted(v[0] for v in current.values())


def test_greedy_near_duplicates(spark):
    # 1~2, 2~3, 1 not ~3: 1 and 3 stay. 4~5~6~7 in a chain; 8 alone.
    pairs = [(1, 2), (2, 3), (4, 5), (5, 6), (6, 7)]
    keep = D.greedy_keep(spark.range(1, 9), spark.createDataFrame(pairs, "a bigint, b bigint"))
    assert ids(keep.filter("keep")) == [1, 3, 4, 6, 8]
    r = random.Random(3)
    pairs = sorted({tuple(sorted(r.sample(range(60), 2))) for _ in range(90)})
    kept = []
    for i in range(60):
        if not any((k, i) in pairs for k in kept):
            kept.append(i)
    assert ids(D.greedy_keep(spark.range(60), spark.createDataFrame(pairs, "a bigint, b bigint")).filter("keep")) == kept


def test_gate_order_of_copies(spark):
    # 2 is near 1; 3 has the bytes of 2, which were seen although 2 itself isn't kept
    docs = spark.createDataFrame([(1, "x", 0), (2, "y", 1), (3, "y", 1), (4, "z", -1)], "id bigint, sha256 string, simhash bigint")
    assert dict(D.gate_duplicates(docs).collect()) == {1: "index", 2: "dup-near", 3: "dup-exact", 4: "index"}


def test_near_pairs_of_radius(spark):
    r = random.Random(5)
    base = [r.getrandbits(64) for _ in range(20)]
    values = base + [b ^ sum(1 << k for k in r.sample(range(64), r.randint(1, 5))) for b in base]
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame(list(enumerate(signed)), "id bigint, simhash bigint")
    want = {(i, j) for j in range(40) for i in range(j) if bin(values[i] ^ values[j]).count("1") <= 3}
    assert {tuple(x) for x in D.near_pairs(df).collect()} == want
    with pytest.raises(ValueError):
        D.near_pairs(df, radius=4)


def links(spark, edges):
    return spark.createDataFrame(edges, "from_host bigint, to_host bigint")


def harmonic(edges):
    out, nodes = defaultdict(set), {x for e in edges for x in e}
    for a, b in edges:
        out[a].add(b)
    score = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        front, seen, d = {s}, {s}, 0
        while front:
            d += 1
            front = {y for x in front for y in out[x]} - seen
            seen |= front
            for y in front:
                score[y] += 1 / d
    return score


def test_harmonic_centrality(spark):
    assert dict(G.harmonic_exact(links(spark, [(1, 2), (2, 3), (2, 2)])).collect()) == {1: 0.0, 2: 1.0, 3: 1.5}
    r = random.Random(1)
    edges = [(a, b) for a, b in {(r.randint(0, 25), r.randint(0, 25)) for _ in range(50)} if a != b]
    assert dict(G.harmonic_exact(links(spark, edges)).collect()) == pytest.approx(harmonic(edges))


def test_hyperball_on_a_star(spark):
    got = dict(G.hyperball(links(spark, [(i, 0) for i in range(1, 201)])).collect())
    assert 150 < got[0] < 250 and all(got[i] == 0 for i in range(1, 201))


def test_percentiles(spark):
    df = spark.createDataFrame([(i, float(i % 5)) for i in range(41)], "node bigint, score double")
    order = sorted(range(41), key=lambda i: (i % 5, i))
    assert dict(G.percentile(df).collect()) == pytest.approx({n: k / 40 for k, n in enumerate(order)})
    assert G.percentile(df.limit(1)).first().pct == 1.0
    for bad in ([], [(1, 2)]):
        with pytest.raises(ValueError):
            G.centrality(links(spark, bad))
    assert G.centrality(links(spark, [(1, 2)]), force=True).count() == 2


def test_rotation_and_quota(spark):
    rows = [(0, b, 10 * b + i, 100) for b in range(4) for i in range(3)] + [(1, 0, 99, 1000), (1, 1, 100, 1)]
    got = {r.id: r.shard for r in C.rotate(spark.createDataFrame(rows, "writer bigint, batch bigint, id bigint, bytes bigint"), 500).collect()}
    assert [got[i] for i in (0, 2, 10, 12, 20, 32)] == [0, 0, 0, 0, 1, 1] and got[99] == got[100] == 0
    offers = spark.createDataFrame([(1, "p", 1, 40), (2, "p", 2, 80), (3, "p", 3, 1)], "id bigint, origin string, created_at bigint, bytes bigint")
    assert ids(C.within_quota(offers, 0, 100)) == [1]  # the third would fit, and waits all the same


def test_search_end_to_end(spark, tmp_path):
    docs = spark.createDataFrame(
        [(1, "http://a/1", "a", "Running shoes", "the best shoes for a run in the park", 0.0), (2, "http://a/2", "a", "Parks", "a run in the park is fun", 0.9), (3, "http://b/3", "b", "Parks", "a run in the park is fun", 0.0), (4, "http://b/4", "b", "Other", "nothing of note", 0.5)],
        "id bigint, url string, host string, title string, body string, centrality double",
    )
    urls = lambda q, **k: [r.url for r in R.search(docs, q, **k).collect()]
    assert urls("parks fun") == ["http://a/2", "http://b/3"]  # same text, higher centrality
    assert urls('"park is fun" site:B') == ["http://b/3"] and urls("runs") == ["http://a/1", "http://a/2", "http://b/3"]
    assert urls("title:running") == ["http://a/1"] and urls("fun note") == [] and urls("") == []
    assert R.total(docs, "park").first().total == 3 and len(urls("park", page_size=2, page=1)) == 1
    R.write_index(docs, str(tmp_path / "i"), buckets=4)
    whole = [(r.url, round(r.score, 6)) for r in R.search(docs, "park fun").collect()]
    assert [(r.url, round(r.score, 6)) for r in R.search_index(str(tmp_path / "i"), docs, ["park", "fun"], buckets=4).collect()] == whole
    peers = [R.peer_hits(R.search(docs.filter(F.col("host") == h), "park"), h, i).withColumn("pos", F.row_number().over(R_order())) for i, h in enumerate("ab")]
    merged = R.federate(peers, 4).collect()
    assert [r.url for r in merged] == ["http://a/1", "http://b/3", "http://a/2"] or [r.url for r in merged] == ["http://a/2", "http://b/3", "http://a/1"]


def R_order():
    from pyspark.sql import Window

    return Window.partitionBy("list_idx").orderBy(F.desc("score"), "url")


def test_outcomes(spark):
    cases = [(None, 1, "retry"), (None, 3, "gone"), (429, 1, "throttled"), (503, 9, "unavailable"), (500, 3, "gone"), (302, 1, "redirected"), (404, 1, "gone"), (200, 1, "stored")]
    df = spark.createDataFrame([(s, a) for s, a, _ in cases], "status int, attempts int")
    assert [r[0] for r in df.select(O.outcome(F.col("status"), F.lit(False), F.lit(True), F.col("attempts"))).collect()] == [o for *_, o in cases]


def test_claims_stream_once_per_url(spark):
    pages = S.read_stream(spark, f"{SF}/pages.parquet")
    found = pages.select(host_of(F.col("url")).alias("host"), "url", F.lit(10**9).cast("bigint").alias("at"))
    out = S.run_once(S.claim_stream(found), "claims")
    assert out.count() == out.select("url").distinct().count() == spark.read.parquet(f"{SF}/pages.parquet").select("url").distinct().count()
    gaps = out.groupBy("host", "claimed_at").count().filter("count > 1")
    assert gaps.count() == 0 and S.commit_due(1000, 0) and S.commit_due(1, 61) and not S.commit_due(0, 99)


def test_claims_over_two_batches(spark, tmp_path):
    """A host's gap holds across micro-batches, nothing is claimed before it arrives, and no URL twice."""
    batches = [[("h", "u1", 1000), ("h", "u2", 1000), ("g", "v1", 1000)], [("h", "u1", 1001), ("h", "u3", 1001), ("g", "v2", 5000), ("g", None, 5000)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, "host string, url string, at bigint").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema("host string, url string, at bigint").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    got = {(r.url, r.claimed_at) for r in S.run_once(S.claim_stream(stream, 60), "claims").collect()}
    assert got == {("u1", 1000), ("u2", 1060), ("u3", 1120), ("v1", 1000), ("v2", 5000)}


def test_simhash_equals_a_plain_loop(spark):
    from hashlib import md5

    texts = ["a b b c", "One  two\nTHREE", "", None, "é ü x" * 50]
    want = {}
    for i, t in enumerate(texts):
        votes = [0] * 64
        for w in (t or "").lower().split():
            h = int.from_bytes(md5(w.encode()).digest()[:8], "big")
            for k in range(64):
                votes[k] += 1 if h >> k & 1 else -1
        if t:
            v = sum(1 << k for k in range(64) if votes[k] > 0)
            want[i] = v - (1 << 64) if v >> 63 else v
    assert dict(D.simhash(spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")).collect()) == want


def test_near_pairs_stand_for_equal_hashes(spark):
    df = spark.createDataFrame([(i, 7 if i < 500 else 6) for i in range(1000)], "id bigint, simhash bigint")
    assert [tuple(r) for r in D.near_pairs(df).collect()] == [(0, 500)] and D.classes(df).filter("first = 0").count() == 500


def passes(df):
    """How often the plan sends rows to Python."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.count("ArrowEvalPython [") + plan.count("MapInArrow ")


def test_simhash_votes_once_on_each_text(spark):
    assert passes(D.simhash(spark.createDataFrame([(1, "a b"), (2, " ")], "id bigint, text string"))) == 1


def test_simhash_looks_up_only_the_words_of_the_text():
    class Held(dict):
        """Words seen before; going through all of them for each text would make the job quadratic."""

        def keys(self):
            raise AssertionError("all words were read")

        __iter__ = items = values = keys

    held = Held({f"w{i}": bytes(8) for i in range(1000)})
    assert D._vote("a b w1", held) == D._vote("b w1 a", held) is not None and len(held) == 1002
    assert D._vote(" ", held) is None and D._vote(None, held) is None


@pytest.mark.parametrize("name", ["near_dup_pairs", "simhash_classes"])
def test_hashes_are_made_once(spark, name):
    assert passes(DEDUP[name][0](spark, SF)) == 0  # they are read back from where they were written


def test_stems_are_counted_in_one_pass_each(spark):
    rows = [(1, "u1", "h", "Running", "he runs, he runs; HE RUN far", 0.0), (2, "u2", "h", None, "", 0.5), (3, "u3", "h", "run", None, None), (None, "u4", "h", "x", "he walks", 0.0)]
    docs = spark.createDataFrame(rows, "id bigint, url string, host string, title string, body string, centrality double")
    t, _ = R._matched(docs, R.parse('run "he runs"'), True)
    got = {r.url: (r.len_title, r.len_body, r.tf_0_title, r.tf_0_body, r.tf_1_body) for r in t.collect()}
    assert got == {"u1": (1, 7, 1, 3, 3), "u2": (0, 0, 0, 0, 0), "u3": (1, 0, 1, 0, 0), "u4": (1, 2, 0, 0, 0)}
    assert R._times(["a", "a", "a"], ["a", "a"]) == 2
    # once for statistics and once for scores; a filter on them doesn't stem all texts a third time
    spark.conf.unset(key := "spark.sql.execution.arrow.maxBytesPerBatch")
    assert passes(R.scored(docs, R.parse("he"), stemming=True)) == 2 and spark.conf.get(key) is not None


def posted(spark, rows, **k):
    docs = spark.createDataFrame(rows, "id bigint, title string, body string")
    return R.postings(docs, **k)


def test_postings_are_made_without_a_shuffle(spark):
    df = posted(spark, [(1, "A b", "b a b"), (2, None, "..."), (None, "c", "")])
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    want = {("a", "title", 1, 1, (0,)), ("b", "title", 1, 1, (1,)), ("b", "body", 1, 2, (0, 2)), ("a", "body", 1, 1, (1,)), ("c", "title", None, 1, (0,))}
    assert {(*r[:4], tuple(r[4])) for r in df.collect()} == want


def test_postings_of_repeated_ids_are_merged(spark):
    df = posted(spark, [(1, "t", "a b"), (1, "t", "a a"), (None, None, "a"), (None, None, "b a"), (2, "t", "a")])
    want = {("t", "title", 1, 2, (0, 0)), ("a", "body", 1, 3, (0, 0, 1)), ("b", "body", 1, 1, (1,)), ("a", "body", None, 2, (0, 1)), ("b", "body", None, 1, (0,)), ("t", "title", 2, 1, (0,)), ("a", "body", 2, 1, (0,))}
    got = df.collect()
    assert len(got) == len(want) and {(*r[:4], tuple(r[4])) for r in got} == want


def test_postings_of_a_long_text_and_many_batches(spark, monkeypatch):
    monkeypatch.setattr(R, "BATCH_POSTINGS", 4)
    df = posted(spark, [(i, "x y", " ".join(f"w{k} w" for k in range(i))) for i in range(40)])
    assert df.count() == 80 + sum(range(40)) + 39 and df.filter("term = 'w'").agg({"tf": "sum"}).first()[0] == sum(range(40))


def test_term_stats_shuffle_terms_only(spark):
    df = R.term_stats(posted(spark, [(1, "A b", "b a b"), (2, "a", "a")], positions=False))
    assert df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    assert {tuple(r) for r in df.collect()} == {("a", "title", 2, 2), ("b", "title", 1, 1), ("b", "body", 1, 2), ("a", "body", 2, 2)}
    again = R.term_stats(posted(spark, [(1, "a", "a b"), (1, "a", "a")], positions=False))
    assert {tuple(r) for r in again.collect()} == {("a", "title", 1, 2), ("a", "body", 1, 2), ("b", "body", 1, 1)}
