"""BPE and token counts against a tokenizer library and plain loops."""

from __future__ import annotations

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm import util
from webloom.llm import bpe, token_scan


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN.replace("++", "+"), mergeable_ranks=bpe.codec().ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_same_ids_as_library(text):
    enc = tiktoken.Encoding("own", pat_str=bpe.PATTERN.replace("++", "+"), mergeable_ranks=bpe.codec().ranks, special_tokens={})
    text = text.encode("utf-8", "ignore").decode()
    ids = bpe.codec().encode(text).tolist()
    assert ids == enc.encode_ordinary(text)
    assert bpe.codec().decode(ids) == text.encode()


@pytest.mark.parametrize("text", ["a" * 5000, "ab" * 3000 + "é" * 700, "", "  \n\n x", "日本語" * 300, "<|endoftext|>", "aaaa aaaaa aaaaaa", "thethethe" * 500])
def test_long_pretokens(library, text):
    assert bpe.codec().encode(text).tolist() == library.encode_ordinary(text)


def test_queue_equals_one_merge_at_a_time():
    c = bpe.codec()
    words = [w.encode() for w in c.split(util.A + util.NEAR_A)] + [b"aaaaaaa", b"abababab", bytes(range(256))]
    for w, ids in zip(words, c.merge_many(words)):
        assert np.frombuffer(ids, np.int32).tolist() == list(c.merge(w))


def test_a_vocabulary_with_lower_ranks_later(tmp_path):
    """Merging bc makes abc, of a lower rank than bc: it goes before the other bc."""
    import base64

    tokens = [bytes([b]) for b in range(256)] + [b"abc", b"bc", b"cb", b"bcb"]
    path = tmp_path / "v.tiktoken"
    path.write_text("\n".join(f"{base64.b64encode(t).decode()} {i}" for i, t in enumerate(tokens)))
    c = bpe.Codec(str(path))
    enc = tiktoken.Encoding("v", pat_str=bpe.PATTERN.replace("++", "+"), mergeable_ranks=c.ranks, special_tokens={})
    for w in ("abcbc", "bcbcb", "abcabcbcb", "cbabcb"):
        assert c.encode(w).tolist() == enc.encode_ordinary(w)


def test_cache_generations(monkeypatch, library):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    c = bpe.Codec()
    for text in (util.A, util.NEAR_A, util.A, "x" * 200, "one two"):
        assert c.encode(text).tolist() == library.encode_ordinary(text)


@pytest.mark.parametrize("make", [util.edge, util.clashing, util.empty])
def test_encode_edges(spark, library, make):
    df = make(spark)
    source = [(r["doc_id"], r[1]) for r in df.collect()]
    out = bpe.encode(df)
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.tokens, r.round_trip) for r in out.collect()), key=repr)
    want = []
    for i, t in source:
        ids = None if t is None else library.encode_ordinary(t)
        want.append((i, None, None, None, None) if t is None else (i, len(t.encode()), len(ids), ids, True))
    assert got == sorted(want, key=repr)
    back = bpe.decode(out)
    assert sorted(map(tuple, back.collect()), key=repr) == sorted(source, key=repr)


@pytest.mark.parametrize("make", [util.edge, util.clashing, util.empty])
def test_count_tokens(spark, library, make):
    df = make(spark).repartition(3)
    got = token_scan.count_tokens(token_scan.write_tokens(df), block_tokens=50)
    want = sorted(len(library.encode_ordinary(r[1])) for r in df.collect() if r[1] is not None)
    assert sorted(r.n_tokens for r in got.collect()) == want
    by_id = sorted(((r["doc_id"], len(library.encode_ordinary(r[1]))) for r in df.collect() if r[1] is not None), key=repr)
    assert util.rows(token_scan.counts(df).select("doc_id", "n_tokens")) == by_id


@pytest.mark.parametrize("block", [1, 2, 3, 7, 100])
def test_stitching(spark, tmp_path, block):
    files = {0: [5, 9, 9, 1, 2, 3], 1: [9], 2: [], 3: [1, 2, 3], 4: [9, 9, 4, 9]}
    rows, want = [], []
    for k, ids in files.items():
        path = tmp_path / f"{k}.bin"
        np.array(ids, "<u2").tofile(path)
        rows.append((k, f"file://{path}", len(ids), None))
        start, doc = 0, 0
        for at, x in enumerate(ids):
            if x == 9:
                want.append((k, doc, start, at - start))
                start, doc = at + 1, doc + 1
        if start < len(ids):
            want.append((k, doc, start, len(ids) - start))
    got = token_scan.count_tokens(spark.createDataFrame(rows, token_scan.FILES), 9, block)
    assert util.rows(got) == sorted(want, key=repr)


@pytest.mark.parametrize("size", [5, 7, 8, 12])
def test_files_of_another_size_are_errors(spark, tmp_path, size):
    path = tmp_path / "x.bin"
    path.write_bytes(b"\1" * size)
    with pytest.raises(Exception, match="bytes instead of 6"):
        token_scan.count_tokens(spark.createDataFrame([(0, f"file://{path}", 3, None)], token_scan.FILES), 9, 2).collect()
