import random
import re
import zlib
from collections import Counter

import pytest

from lexiloom.llm import spelling as s


def apart(a, b):
    """True at exactly one inserted, deleted or replaced code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_vocabulary(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            out[run] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def plain_variants(words):
    near = {w: [v for v in words if apart(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None
    out = []
    for w in words:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, words[w], len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def made(rng, size):
    """Words with many near ones: a few stems, edited again and again."""
    letters = "abcdé×"
    stems = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 9))) for _ in range(size // 12)]
    out = set(stems)
    while len(out) < size:
        w = rng.choice(stems if rng.random() < 0.7 else sorted(out))
        i = rng.randrange(len(w) + 1)
        w = rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]])
        if len(w) >= 5:
            out.add(w)
    return out


def test_query_by_brute_force(spark, tmp_path):
    rng = random.Random(1)
    words = sorted(made(rng, 250))
    weights = [rng.choice([1, 1, 2, 5, 40]) for _ in words]
    rows = [(i, " ".join(w.title() if rng.random() < 0.2 else w for w in rng.choices(words, weights, k=60))) for i in range(150)]
    rows += [(None, "Alpha alpha; alphAĀalpha ALPHA"), (7, None), (7, ""), (8, "😀 naïve NAÏVE naïve naive naives naives Naives " * 3), (8, "漢alphab alphabe" * 4)]
    rows = [(i, t and t.encode("utf-16", "surrogatepass").decode("utf-16")) for i, t in rows]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, n string").write.parquet(str(tmp_path / "documents.parquet"))
    got = s.op13_spelling_variants(spark, str(tmp_path))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_variants(plain_vocabulary(rows))
    assert sorted(map(tuple, got.collect())) == want
    assert len({r[2] for r in want}) < len(want) and any(r[1] and r[2] != r[1] for r in want)


@pytest.mark.parametrize("group,shard", [(5000, 20_000), (40, 30), (7, 1000)])
def test_pairs_of_any_grouping(spark, group, shard):
    words = {w: i % 9 + 1 for i, w in enumerate(sorted(made(random.Random(2), 500) | {"aaaaa", "aaaaaa", "aaaaaaa", "aabaaa"}))}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    got = sorted(map(tuple, s.near_pairs(df, group, shard).collect()))
    assert got == sorted((a, words[a], b, words[b]) for a in words for b in words if apart(a, b))


def test_common_front_of_a_third(spark):
    """Most words share their front: the segment is refined until groups are small."""
    rng = random.Random(3)
    words = {"prefix" + "".join(rng.choice("abcdefgh") for _ in range(6)): 3 for _ in range(2000)} | {"prefixaaaaaa": 9}
    df = spark.createDataFrame(list(words.items()), "word string, n long")
    patterns, scanned = s._routed(df, 64)
    assert patterns.groupBy("key").count().agg({"count": "max"}).first()[0] <= 64
    got = {(r["word"], r["near"]) for r in s.near_pairs(df, 64, 500).collect()}
    keys = sorted(words)
    assert got == {(a, b) for a in keys for b in keys if sum(x != y for x, y in zip(a, b, strict=True)) == 1}


def test_chains_of_forms(spark):
    chain = [(f"w{i:03d}", f"w{i + 1:03d}") for i in range(40)]
    got = dict(map(tuple, s.roots(spark.createDataFrame(chain, "word string, form string")).collect()))
    assert got == {w: "w040" for w, _ in chain}


def test_empty(spark):
    docs = spark.createDataFrame([(1, None), (2, "ab")], "doc_id long, text string")
    assert s.variants(s.vocabulary(docs)).count() == 0
    assert s.variants(s.vocabulary(docs.limit(0))).columns == ["word", "form", "root", "n", "n_near", "form_n"]
