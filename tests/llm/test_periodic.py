import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import periodic as p


def plain_runs(words, min_exp=4, min_len=6):
    """By definition: all stretches of every period, smallest periods by trial."""
    n, out = len(words), []
    for q in range(1, n // min_exp + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            part = words[i : i + length]
            if length >= max(min_len, min_exp * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                out.append((i, length, q))
            i = j + 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def made(rng):
    kind = rng.random()
    n = rng.choice([0, 1, 5, 6, 7, 20, 60, 200])
    words = [rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(n)]
    if kind < 0.7 and n > 10:
        a, q = rng.randrange(n), rng.randint(1, 1 + n // 4)
        words = [w if i < a else words[min(n - 1, a + (i - a) % q)] for i, w in enumerate(words)]
    if kind < 0.3 and n > 10:
        words[rng.randrange(n)] = "z"
    return words


def test_runs_by_definition():
    rng = random.Random(1)
    for _ in range(1500):
        words = made(rng)
        ids = p.word_ids([w.encode() for w in words])
        want = plain_runs(words)
        assert p.runs_of(ids) == want
        octaves = [r for k in range(12) for r in p.runs_of(ids, 1 << k, (2 << k) - 1)]
        assert sorted(octaves, key=lambda r: (r[0], r[2])) == want


@pytest.mark.parametrize("min_exp,min_len", [(2, 2), (2, 9), (3, 1), (7, 30)])
def test_other_bounds(min_exp, min_len):
    rng = random.Random(2)
    for _ in range(300):
        words = made(rng)
        assert p.runs_of(p.word_ids([w.encode() for w in words]), min_exp=min_exp, min_len=min_len) == plain_runs(words, min_exp, min_len)


def test_long_and_repetitive():
    rng = np.random.default_rng(3)
    ids = rng.integers(0, 50, 300_000).astype(np.uint32)
    ids[1000:41000] = np.tile(ids[1000:6000], 8)
    assert (1000, 40000, 5000) in p.runs_of(ids)
    assert p.runs_of(np.zeros(200_000, np.uint32)) == [(0, 200_000, 1)]
    two = np.concatenate([np.zeros(50_000, np.uint32), np.ones(50_000, np.uint32)])
    assert p.runs_of(two) == [(0, 50_000, 1), (50_000, 50_000, 1)]
    assert p.runs_of(np.tile(np.arange(3, dtype=np.uint32), 40_000)) == [(0, 120_000, 3)]


def plain_digests(doc_id, text):
    words = [w.decode() for w in (text or "").encode().split()]
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            q = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % q] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, k, q in runs for i in range(s + q, s + k)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    top = (None,) * 4 if best is None else (*best, 1000 * best[1] // best[2])
    return (doc_id, len(runs), *top, sha("".join(f"{s},{k},{q}\n" for s, k, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_query_by_definition(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, " ".join(made(rng))) for i in range(400)]
    rows += [(None, "a a a a a a a"), (7, "a b a b a\tb \x0b a b\na b a b \U0001f600"), (8, None), (9, ""), (9, " \n "), (10, "x " * 3000), (10, "x " * 3000), (11, "x\x1cy " * 9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = p.op12_periodic_runs(spark, str(tmp_path))
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted((plain_digests(*r) for r in rows), key=key)
    assert any(zlib.crc32(str(i).encode()) % 10 == 0 and r[1] for i, r in enumerate(rows[:400]))


def test_long_texts_by_octaves(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(made(rng) * 2), "t") for i in range(60)] + [(None, None, "t"), (3, "b b b b b b b", "t")]
    docs = spark.createDataFrame(rows, "runs long, text string, __row string")
    short, long = p.find_runs(docs), p.find_runs(docs, long=40)
    assert short.columns == long.columns == ["runs", "text", "__row", "runs", "collapsed"]
    flat = lambda df: sorted(map(str, df.collect()))
    assert flat(short) == flat(long)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert p.find_runs(docs).count() == 0
    assert p.find_runs(docs, long=0).select(F.size("runs")).count() == 0
