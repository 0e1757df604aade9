import hashlib

import numpy as np

from lexiloom.llm import fingerprint as fp


def brute(text, k, s):
    """Closed syncmer places by their definition, over the same hashes."""
    points = np.array([ord(c) for c in text], np.uint64)
    inner = fp._grams(points, s)
    out = []
    for i in range(len(text) - k + 1):
        w = inner[i : i + k - s + 1]
        if w.min() in (w[0], w[-1]):
            out.append(i)
    return out


def test_syncmers_by_definition():
    text = "the quick brown fox jumps over the lazy dog " * 5 + "été 日本 😀 end of it all"
    points = np.array([ord(c) for c in text], np.uint64)
    for k, s in (fp.LONG, fp.SHORT, (9, 3)):
        at, h = fp.syncmers(points, k, s)
        assert at.tolist() == brute(text, k, s)
        by = {}
        for i, x in zip(at.tolist(), h.tolist(), strict=True):
            assert by.setdefault(text[i : i + k], x) == x  # equal k-mers, equal hashes
        assert len(set(by.values())) == len(by)


def test_likeness():
    a = "one two three four five six seven eight nine ten eleven twelve " * 3
    assert fp.likeness(fp.anchors(a), fp.anchors(a)) == 1
    assert fp.likeness(fp.anchors(""), fp.anchors("")) == 1
    assert fp.likeness(fp.anchors(""), fp.anchors("x")) == 0
    assert fp.packed(fp.anchors("")) == ""
    assert fp.likeness(fp.anchors(a), fp.anchors("x" + a[:-1])) > 0.5  # moved by one


def test_frame(spark):
    data = [(5, "a" * 10 + "lorem ipsum dolor sit amet " * 20, 1), (3, None, 2), (9, "short", 3), (9, "short", 3), (1, "kurzer Text mit Wörtern 日本 " * 9, 4), (None, "null id", 5), (7, "x", 6)]
    df = spark.createDataFrame(data, "doc_id long, text string, part int")
    got = sorted((r.asDict() for r in fp.fingerprints(df).collect()), key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0))
    order = sorted(((d, t or "") for d, t, _ in data), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert len(got) == len(order)
    for i, (d, t) in enumerate(order):
        nxt = order[i - 1][1]
        e = t[: len(t) - len(t) // 3] + nxt[: len(t) // 3]
        r = got[i]
        assert (r["doc_id"], r["n_chars"]) == (d, len(t))
        assert r["edited_sha256"] == hashlib.sha256(e.encode()).hexdigest()
        assert r["fingerprint"] == fp.packed(fp.anchors(t)) and r["edited_fingerprint"] == fp.packed(fp.anchors(e))
        assert r["near_edited"] == fp.likeness(fp.anchors(t), fp.anchors(e)) and r["near_next"] == fp.likeness(fp.anchors(t), fp.anchors(nxt))
    assert fp.fingerprints(df.limit(0)).count() == 0
    one = fp.fingerprints(df.where("doc_id = 5")).collect()
    assert len(one) == 1 and one[0].near_next == 1.0


def test_documents(spark):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars >= 200")
    rows = fp.fingerprints(df).toPandas()
    assert (rows.near_edited > 0.25).mean() > 0.97 and rows.near_edited.mean() > 0.45
    assert rows.near_next.quantile(0.9) < 0.05
