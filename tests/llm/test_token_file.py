import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from lexiloom.llm import token_file as tf


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 1), st.integers(0, 60), st.integers(0, 50000), st.integers(0, 2**64 - 1), st.just(0)), max_size=700))
def test_round_trip(values):
    ids = np.array(values, np.uint64)
    words, counts = tf.pack(ids)
    assert int(counts.sum()) == len(ids)
    assert np.array_equal(tf.unpack(words), ids)


def test_dense():
    ids = np.concatenate([np.zeros(1000, np.uint64), np.ones(600, np.uint64), np.full(10, 2**61, np.uint64)])
    words, _ = tf.pack(ids)
    assert len(words) <= 9 + 11 + 12 and np.array_equal(tf.unpack(words), ids)


def test_segment_blocks():
    r = np.random.default_rng(3)
    ids = r.integers(0, 50000, 30000).astype(np.uint64)
    ids[::500] = 2**62
    seg = tf.Segment(tf.segment([4, 9, 9], [10000, 0, 20000], ids))
    assert np.array_equal(seg.ids(), ids) and seg.doc_ids.tolist() == [4, 9, 9] and seg.doc_start.tolist() == [0, 10000, 10000]
    assert np.array_equal(np.concatenate([seg.block(k) for k in range(len(seg.blocks))]), ids)
    for a, b in ((0, 1), (777, 778), (9999, 20001), (29999, 30000), (5, 5)):
        assert np.array_equal(seg.ids(a, b), ids[a:b])
    with pytest.raises(ValueError):
        tf.Segment(b"nothing of that kind")


TEXTS = [None, "", " ", "Hello, Wörld!! it's 12", "a" * 5000, "日本 ΣΑΣ é", "tab\tnew\nline\r\n", "<|endoftext|> x", "ÀÉÎ ÿß øØ 3.14 *** $$$", "it''s 's", "x\x1cy\x0bz", "the " * 40000]


def test_frame(spark):
    tok = Tokenizer.from_file(tf.default_path())
    rows = [(i * 3 if i != 5 else None, t, 0) for i, t in enumerate(TEXTS)] + [(6, "same id", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, part int")
    got = tf.read_tokens(tf.write_tokens(df)).orderBy("start").collect()
    ids = {}
    for d, t, _ in rows:
        ids.setdefault(d, []).append([*tok.encode(t or "", add_special_tokens=False).ids, 1])
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
        own = next(x for x in ids[r.doc_id] if len(x) == r.n_tokens and zlib.crc32(np.array(x, "<u4").tobytes()) == r.ids_crc32)
        ids[r.doc_id].remove(own)
    assert not any(ids.values())
    order = [r.doc_id for r in got]
    assert order[0] is None and order[1:] == sorted(order[1:])
    assert tf.read_tokens(tf.write_tokens(df.limit(0))).count() == 0


def test_documents(spark):
    tok = Tokenizer.from_file(tf.default_path())
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want, at = [], 0
    for r in df.orderBy("doc_id").collect():
        x = np.array([*tok.encode(r.text, add_special_tokens=False).ids, 1], "<u4")
        want.append((r.doc_id, at, len(x), zlib.crc32(x.tobytes())))
        at += len(x)
    assert sorted(map(tuple, tf.read_tokens(tf.write_tokens(df)).collect())) == want
