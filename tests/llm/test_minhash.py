import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiloom.llm import minhash as m
from lexiloom.llm import groups
from lexiloom.llm.groups import components, extended


def brute(rows):
    """Classes by all pairs, exact shingles of words themselves; likenesses by their definitions."""
    sets, by = {}, {}
    for i, t in rows:
        w = (t or "").split()
        by.setdefault(t or "", []).append(i)
        sets[i] = Counter(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else Counter()
    ids = [i for i, _ in rows]
    up = {i: i for i in ids}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    def join(a, b):
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)

    for g in by.values():
        for x in g:
            join(g[0], x)
    first = [min(g) for g in by.values()]
    for k, a in enumerate(first):
        for b in first[:k]:
            if sets[a].keys() & sets[b].keys() and alike(sets[a], sets[b]) >= 0.8:
                join(a, b)
    return {i: root(i) for i in ids}


def alike(x, y):
    every, both = x.keys() | y.keys(), x.keys() & y.keys()
    plain = len(both) / len(every)
    if plain >= 0.8 or max(*x.values(), *y.values()) == 1 or plain < 0.3:
        return plain
    u, v = (np.array([1 + np.log(c[d]) if c[d] else 0 for d in every]) for c in (x, y))
    return max(plain, sum(1 / np.maximum(u / u[i], v / v[i]).sum() for i in np.flatnonzero(u * v)))


def made(n=150, seed=4):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(5))
    rows = []
    base = [word() for _ in range(200)]
    for i in range(n):
        kind = r.random()
        if kind < 0.45:  # near copies of one text, more or less far off
            t = [w if r.random() > 0.035 else word() for w in base]
        elif kind < 0.6:
            t = base[:150] + [word() for _ in range(r.randint(5, 60))]
        elif kind < 0.7 and rows:
            t = (r.choice(rows)[1] or "").split()
        else:
            t = [word() for _ in range(r.choice([1, 2, 4, 5, 6, 30, 400]))]
        rows.append((1000 - i * 3, " ".join(t)))
    return rows + [(2000, None), (2001, ""), (2002, " \n"), (2003, "one"), (2004, "one "), (2005, "x " * 3000)]


def test_like_brute_force(spark):
    rows = made()
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.id: r.class_id for r in m.classes(df).collect()}
    assert got == brute(rows)


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    got = {r.id: r.class_id for r in m.classes(df).collect()}
    assert got == brute([(r.doc_id, r.text) for r in df.collect()])
    kept = m.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == sorted({*got.values()})


def test_odd(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (7, "a b c d e f"), (9, None)], "doc_id long, text string")
    got = sorted((r.id, r.class_id) for r in m.classes(df).collect())
    low = m.NULL_ID
    assert got == [(low, low), (7, low), (7, low), (9, 9)]
    assert m.drop_near_duplicates(df).count() == 2
    assert m.classes(df.limit(0)).count() == 0


def test_texts_under_one_id(spark):
    text = lambda k: " ".join(f"w{k}x{j}" for j in range(60))
    rows = [(1, text(1), "a"), (5, text(1) + " end", "b"), (5, text(2), "c"), (None, text(3), "d"), (None, text(4), "e"), (None, text(4), "d"), (8, text(2) + " end", "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    for some in (df, df.repartition(3)):
        got = m.drop_near_duplicates(some)
        assert got.columns == df.columns
        assert sorted(map(tuple, got.collect()), key=str) == sorted([rows[0], rows[2], rows[3], rows[5]], key=str)


def test_counts_apart(spark):
    """Near copies by their sets of shingles whose counts differ strongly."""
    r = random.Random(8)
    rows = []
    for k in range(25):
        words = [f"w{k}x{j}" for j in range(100)]
        loop = " ".join(words[:30])
        # the second text says its first 30 words over and over: its set has the same shingles and four at the seams
        rows += [(10 * k, " ".join(words)), (10 * k + 1, f"{(loop + ' ') * 300}{' '.join(words)} own{k}" + "".join(f" o{r.random()}" for _ in range(9)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert all(want[10 * k + 1] == 10 * k for k in range(25))
    assert {x.id: x.class_id for x in m.classes(df).collect()} == want


def row(i, pair, plain, weighted):
    apart = (plain != weighted).any()
    keys = np.concatenate([m.band_keys(plain[None])[0], m.band_keys(weighted[None])[0]] if apart else [m.band_keys(plain[None])[0]])
    short, short_w = ((x & np.uint64(255)).astype(np.uint8).tobytes() for x in (plain, weighted))
    return {"id": i, "component": i, "place": 0, "size": len(pair[0]), "sketch": short, "sketch_w": short_w if apart else b"", "keys": keys.tolist(), "parity": m.parity(pair[0]).tobytes()}


def test_contested_bucket():
    """Round 3 lets pairs of either likeness through, once each."""
    r = np.random.default_rng(6)
    meet, lost = m.meet_of(m.LIKENESS), 0
    for k in range(60):
        h = np.sort(r.integers(0, 2**63, 110).astype(np.uint64))
        a, b = (h[:100], np.ones(100)), (h[10:], np.where(np.arange(100) < 30, 300, 1))
        if k % 2:  # alike by weight only
            c = np.where(np.arange(110) < 60, 400, 1)
            a, b = (h[:85], c[:85]), (np.concatenate([h[:60], h[85:]]), np.concatenate([c[:60], c[85:]]))
            assert m.jaccard(a[0], b[0]) < 0.6 and m.likeness_of(a[0], b[0], *(x[1].astype("<u4").tobytes() for x in (a, b))) >= 0.8
        plain, weighted = m.both_sketches([a, b])
        one, two = (row(i, x, plain[i], weighted[i]) for i, x in enumerate((a, b)))
        shared = set(one["keys"]) & set(two["keys"])
        times = sum(len(meet(key, [one], [two])) for key in shared)
        lost += times != 1
    assert lost <= 1


@pytest.mark.parametrize("count", [1, 5, 50, 500])
def test_bands_whatever_the_counts(count):
    """Pairs of plain likeness 0.8 whose own shingles repeat share a band and are links."""
    r = np.random.default_rng(9)
    for _ in range(200):
        h = r.integers(0, 2**63, 100).astype(np.uint64)
        pair = []
        for own in (h[80:90], h[90:]):
            x = np.concatenate([h[:80], own])
            c = np.concatenate([np.ones(80, int), np.full(10, count)])
            order = np.argsort(x)
            pair.append((x[order], c[order]))
        plain, weighted = m.both_sketches(pair)
        keys = [set(m.band_keys(plain)[i]) | set(m.band_keys(weighted)[i]) for i in (0, 1)]
        assert keys[0] & keys[1]
        assert m.likeness_of(pair[0][0], pair[1][0], *(c.astype("<u4").tobytes() for _, c in pair)) >= 0.8


def test_probability_jaccard():
    r = np.random.default_rng(3)
    for _ in range(50):
        h = np.sort(r.integers(0, 2**63, 60).astype(np.uint64))
        u, v = (np.where(r.random(60) < 0.7, r.integers(1, 9, 60), 0) for _ in range(2))
        want = sum(1 / np.maximum(u / u[i], v / v[i]).sum() for i in np.flatnonzero(u * v))
        assert abs(m.probability_jaccard(h[u > 0], u[u > 0], h[v > 0], v[v > 0]) - want) < 1e-12


def test_refined_buckets(spark, monkeypatch):
    """Buckets of many strays are dealt by further keys, and no link goes."""
    monkeypatch.setattr(groups, "MANY", 3)
    rows = made(120, 7)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.id: r.class_id for r in m.classes(df).collect()} == brute(rows)


def test_extended(spark):
    first, more = [(1, 2), (2, 3), (10, 11), (20, 21)], [(3, 30), (11, 40), (40, 41), (50, 51), (21, 20)]
    found = extended(components(spark.createDataFrame(first, "a long, b long")), spark.createDataFrame(more, "a long, b long"))
    want = {1: 1, 2: 1, 3: 1, 30: 1, 10: 10, 11: 10, 40: 10, 41: 10, 20: 20, 21: 20, 50: 50, 51: 50}
    assert sorted((r.id, r.component) for r in found.collect()) == sorted(want.items())


def test_clashing_columns(spark):
    rows = [(1, "a b c d e f", 1, "x"), (2, "a b c d e f", 2, "y"), (None, "other words", 3, "z"), (None, "more", 4, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __id int, `a.b` string").withColumn("hash", F.lit(1)).withColumn("id", F.lit(2))
    got = m.drop_near_duplicates(df)
    assert got.columns == df.columns and sorted(r["__id"] for r in got.collect()) == [1, 3, 4]


def test_parity_bound():
    r = np.random.default_rng(7)
    for n in (3, 100, 1000, 20000):
        for own in (0, 1, n // 9, n):
            h = r.integers(0, 2**63, n + 2 * own).astype(np.uint64)
            apart = int(np.bitwise_count(m.parity(h[: n + own]) ^ m.parity(h[own:])).sum())
            assert apart <= 2 * own and (own < n or n > 100 or apart > n)


def test_sketch_estimates():
    r = np.random.default_rng(2)
    for low, share in ((300, 0.8), (2000, 0.6), (60, 0.9), (8, 0.75), (1, 1.0)):
        diffs = []
        for _ in range(40):
            n = max(1, round(low * share))
            both = r.integers(0, 2**63, n).astype(np.uint64)
            own = [r.integers(0, 2**63, (low - n) // 2 + 0).astype(np.uint64) for _ in range(2)]
            a, b = (np.unique(np.concatenate([both, o])) for o in own)
            s = m.sketches([(a, np.ones(len(a))), (b, np.ones(len(b)))])
            diffs.append((s[0] == s[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
        assert abs(np.mean(diffs)) < 0.02


def test_weighted_estimate():
    """Against the probability Jaccard likeness by its definition."""
    r = np.random.default_rng(5)
    h = np.sort(r.integers(0, 2**63, 120).astype(np.uint64))
    diffs = []
    for _ in range(40):
        u, v = (r.integers(1, 9, 120) for _ in range(2))
        x, y = 1 + np.log(u), 1 + np.log(v)
        want = sum(1 / np.maximum(x / x[i], y / y[i]).sum() for i in range(120))
        s = m.sketches([(h, u), (h, v)])
        diffs.append((s[0] == s[1]).mean() - want)
    assert abs(np.mean(diffs)) < 0.02


def test_components(spark):
    r = random.Random(1)
    edges = [(i, i + 1) for i in range(30)] + [(100, x) for x in range(101, 130)] + [(r.randint(200, 300), r.randint(200, 300)) for _ in range(60)]
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {x.id: x.component for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: root(i) for e in edges for i in e if e[0] != e[1]}
