import hashlib
import random
import unicodedata

import duckdb
import pytest
from tokenizers import Tokenizer

from lexiloom.llm import bpe

PATH = bpe.word_bpe()


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def enc():
    return bpe.Encoder(bpe.merges(PATH), 1000)


def check(tok, enc, text):
    ids = tok.encode(text, add_special_tokens=False).ids
    assert enc.encode(text) == ids
    n, a, b = enc.digest(text)
    assert n == len(ids)
    assert a == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert b == hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


@pytest.mark.parametrize(
    "text",
    ["", " ", "\n\n", "a", "Hello Wörld 123's it's we'll", "<|endoftext|> x<|startoftext|>y <|end", "ΑΣ ΣΑΣ İstanbul ǅ", "é ́x   a b\x1c c\x85d e",
     "日本語 テキスト 한국어 가", "😀👩‍👩‍👧 zero‍width", "x" * 5000, "abab" * 2000, "!" * 3000, "''s's'll", "١٢٣ ⅷ ²", "the" * 1000 + "\tin" * 10, "﻿a\u0000b"],
)
def test_like_library(tok, enc, text):
    check(tok, enc, text)


def test_random(tok, enc):
    r = random.Random(5)
    pieces = [p.decode() for p in bpe.merges(PATH).piece.values() if not p.startswith(b"<|")]
    for _ in range(300):
        text = "".join(r.choice(pieces).replace("</w>", r.choice(["", " ", "\n"])) for _ in range(r.randint(1, 60)))
        check(tok, enc, text)
        check(tok, enc, "".join(r.choice("aeinrst") for _ in range(r.randint(1, 400))))
        check(tok, enc, "".join(chr(r.choice([r.randint(32, 127), r.randint(128, 0x2FFF), r.randint(0x1F300, 0x1F6FF)])) for _ in range(30)))


def test_all_code_points(tok, enc):
    """Every code point before, between and behind others, without exception; canonical decompositions with more marks."""

    def library(text):
        return [bytes(bpe.BYTE_OF[c] for c in w).decode() for w, _ in tok.pre_tokenizer.pre_tokenize_str(tok.normalizer.normalize_str(text))]

    every = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for i in range(0, len(every), 512):
        text = "\n".join(f"x{chr(c)}y !{chr(c)}! 1{chr(c)}" for c in every[i : i + 512])
        assert enc.pre(text) == library(text)
    apart = [n for c in every if not 0xAC00 <= c < 0xD7A4 and (n := unicodedata.normalize("NFD", chr(c))) != chr(c)]
    for text in [x for n in apart for x in (n, f"a{n}\u0323\u0301", f"{n}\u0300")]:
        assert enc.pre(text) == library(text)
    check(tok, enc, "a\u0558b \U00011935\U00011930 \ua7cb!" * 3)


def test_documents(tok, enc):
    for (text,) in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall():
        check(tok, enc, text)


def test_stream_needs_bounded_memory():
    m = bpe.merges(PATH)
    for word in ("ab" * 50_000, "a" * 50_000, "thereinon" * 9_000):
        one, got, fed = bpe.Transducer(m), [], 0
        for i in range(0, len(word), 97):
            got += one.feed(word[i : i + 97].encode())
            assert len(one.chain) <= 12 * m.lookahead
        got += one.finish()
        assert b"".join(m.piece[i] for i in got).decode() == word


def test_decode_text(tok, enc):
    d = bpe.Decoder(enc.m, pieces=False)
    out = "".join(d.feed([i]) for i in enc.encode("Größe 日本 ok")) + d.finish()
    assert out == "größe 日本 ok "


def test_frame(spark):
    rows = spark.createDataFrame([(1, None, 5), (2, "", 6), (2, "", 6), (3, "a b", 7)], "doc_id long, text string, n_tokens int")
    got = {(r.doc_id, r.n_tokens) for r in bpe.encode_digests(rows).collect()}
    assert got == {(1, 0), (2, 0), (3, 2)}
    assert bpe.encode_digests(rows.limit(0)).count() == 0
