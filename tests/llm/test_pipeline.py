"""The pipeline against its stages' definitions, and the registered queries."""

from __future__ import annotations

import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from tests.conftest import SF
from tests.llm import util
from tests.llm.test_dedup import brute_near
from webloom.llm import containment, ppm_langid, registry
from webloom.session import bound_batches


def test_stages_and_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bins = corpus_pipeline.run(spark, SF).collect()
    packed = Counter()
    for b in bins:
        for m in b.members:
            packed[m.doc_id] += m.n_tokens
    first = {}
    for r in sorted(docs.collect(), key=lambda r: r.doc_id):
        if r.text and any(c.isalpha() for c in r.text):
            first.setdefault(r.text, r.doc_id)
    data = sorted((i, t) for t, i in first.items())
    _, root = brute_near(data)
    want = {data[i][0]: len(data[i][1].split()) for i, r in enumerate(root) if r == i}
    assert packed == want
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "packing"]


def test_every_operator_is_registered():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert set(registry.queries()) | {"pipeline"} <= names
    assert {int(n[2:].split("_")[0]) for n in registry.queries()} == set(range(1, 11))


def test_fingerprints_have_sql():
    assert {"op8_exact_dedup", "op9_imatch_fingerprints"} <= set(registry.oracle_sql())


def long_rows(n: int) -> list[str]:
    base = util.prose(90, 700)
    return [f"{i} {base}" for i in range(n)]


class Bounded:
    """A model that takes only batches of under 4 MB."""

    languages = ["en"]

    def totals(self, arr):
        if arr.nbytes > 4 << 20:
            raise ValueError(f"a batch of {arr.nbytes} bytes")
        return np.ones((len(arr), 1))


def bounded(run):
    """run, for batches of under 4 MB."""

    def spy(batches):
        for b in batches:
            if b.nbytes > 4 << 20:
                raise ValueError(f"a batch of {b.nbytes} bytes")
            yield from run(iter([b]))

    return spy


@pytest.mark.parametrize("stage", ["language_id", "near_dedup"])
def test_texts_reach_python_in_small_batches(spark, monkeypatch, tmp_path, stage):
    data = [(i, t, "en") for i, t in enumerate(long_rows(1000))]  # about 5 MB
    spark.createDataFrame(data, "doc_id bigint, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    monkeypatch.setattr(containment, "_sketch", bounded(containment._sketch))
    monkeypatch.setattr(ppm_langid, "train_all", lambda texts: Bounded())
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.unset(key)
    kept = dict(corpus_pipeline.STAGES)[stage](spark, docs, SF).count()
    assert kept == (1000 if stage == "language_id" else 1)
    spark.conf.unset(key)


def test_a_batch_size_that_is_set_stands(spark):
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.conf.set(key, "3m")
    bound_batches(spark)
    assert spark.conf.get(key) == "3m"
    spark.conf.unset(key)


def test_texts_are_worked_on_in_little_memory():
    texts = pa.array(long_rows(600))  # about 3 MB
    n = pa.array(np.arange(600))
    batch = pa.RecordBatch.from_arrays([n, n, n, n, texts], ["part", "doc_id", "t_hi", "t_lo", "text"])
    batch = batch.set_column(0, "part", n.cast(pa.int32()))
    model = ppm_langid.train({"en": [util.prose(91, 300).encode()], "xx": [b"zz yy"]})
    tracemalloc.start()
    try:
        for work in (lambda: sum(b.num_rows for b in containment._sketch(iter([batch]))), lambda: len(model.totals(texts))):
            tracemalloc.reset_peak()
            assert work() == 600
            assert tracemalloc.get_traced_memory()[1] < 16e6
    finally:
        tracemalloc.stop()
