import numpy as np
import pytest

from lexiloom.llm import audio as a
from lexiloom.llm import groups


def tune(seed, notes=60):
    r = np.random.default_rng(seed)
    hz = 440 * 2 ** (r.integers(-10, 11, notes) / 12)
    return 0.7 * np.sin(np.cumsum(np.repeat(2 * np.pi * hz / a.RATE, a.NOTE)))


def test_items_by_definition():
    frames = np.random.default_rng(1).random((40, a.CLASSES)).astype(np.float32)
    got = a.items(frames)
    for t in range(len(got)):
        want = 0
        for kind, p, h, w in a.FILTERS:
            x = frames[t : t + w, p : p + h].astype(float)
            top, left = x[:, : h // 2], x[: w // 2]
            if kind == 0:
                one, two = top.sum(), x[:, h // 2 :].sum()
            elif kind == 1:
                one, two = left.sum(), x[w // 2 :].sum()
            elif kind == 2:
                one = left[:, : h // 2].sum() + x[w // 2 :, h // 2 :].sum()
                two = x.sum() - one
            elif kind == 3:
                one = x[:, h // 3 : 2 * h // 3].sum()
                two = (x.sum() - one) / 2
            else:
                one = x[w // 3 : 2 * w // 3].sum()
                two = (x.sum() - one) / 2
            v = round(float(np.log((1 + one) / (1 + two))), 6)
            level = (v >= -a.STEP) + (v >= 0) + (v >= a.STEP)
            want = want << 2 | (level ^ level >> 1)
        assert int(got[t]) == want


def test_pitch_classes():
    for semitones in range(-12, 13, 5):
        hz = 440 * 2 ** (semitones / 12)
        c = a.chroma(np.sin(np.arange(20000) * 2 * np.pi * hz / 8000), 8000)
        assert (c.argmax(axis=1) == semitones % 12).all() and np.allclose(np.linalg.norm(c, axis=1), 1, atol=1e-3)


def test_align():
    x = tune(1)
    p = a.fingerprint(a.write_wav(x, a.RATE))
    hop = 1 << 10
    moved = a.fingerprint(a.write_wav(x[12 * (hop // 3) :], a.RATE))
    assert a.align(p, moved)[0] == 12 and a.align(p, moved)[2] < 0.02
    noise = a.fingerprint(a.write_wav(x + 0.05 * np.random.default_rng(3).standard_normal(len(x)), a.RATE))
    assert a.align(p, noise)[2] < a.WRONG
    far = a.align(p, a.fingerprint(a.write_wav(tune(2), a.RATE)))
    assert far is None or far[2] > a.WRONG


def test_classes(spark):
    rows, want = [], {}
    for k in range(6):
        for j in range(4):
            x = tune(k)
            x = (x, x[7 * 341 :], x + 0.03 * np.random.default_rng(j).standard_normal(len(x)), x)[j]
            rows.append((10 * k + j, a.write_wav(x, a.RATE), "c"))
            want[10 * k + j] = 10 * k
    silent = a.write_wav(np.zeros(30000), a.RATE)
    rows += [(100, silent, "c"), (101, silent, "c"), (102, None, "c"), (103, b"", "c"), (104, b"RIFFxxxx", "c"), (105, a.write_wav(np.zeros(10), 8000), "c"), (10, rows[4][1], "c")]
    want |= {100: 100, 101: 100} | {i: i for i in (102, 103, 104, 105)}
    df = spark.createDataFrame(rows, "id long, audio binary, print string")
    got = {r.id: r.class_id for r in a.classes(df).collect()}
    assert got == want
    assert a.classes(df.limit(0)).count() == 0


def test_vectors(spark):
    """Classes of the query against all pairs of recordings by alignment alone."""
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    found = a.classes(a.render(rows.selectExpr("vec_id as id", "embedding as vector"))).collect()
    prints = {r.id: np.frombuffer(r.print, "<u4") for r in found}
    up = {i: i for i in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in prints:
        for j in prints:
            if i < j:
                got = a.align(prints[i], prints[j])
                if np.array_equal(prints[i], prints[j]) or got is not None and got[2] <= a.WRONG:
                    x, y = root(i), root(j)
                    up[max(x, y)] = min(x, y)
    want = {i: root(i) for i in prints}
    assert sum(r.class_id == want[r.id] for r in found) >= 0.98 * len(found)


@pytest.mark.parametrize(("noise", "errors", "least"), [(0, 0, 1.0), (0.05, 0.05, 0.99), (0.35, 0.10, 0.97), (0.45, 0.15, 0.9)])
def test_recall(noise, errors, least):
    """Pairs that align() accepts share a key: whole recordings, and clips of half."""
    got = {"whole": [], "half": []}
    for seed in range(120):
        r = np.random.default_rng(seed)
        x = tune(seed)
        p, q = (a.fingerprint(a.write_wav(0.5 * y, a.RATE)) for y in (x, x + noise * r.standard_normal(len(x))))
        start = int(r.integers(0, len(q) // 2))
        for kind, y in (("whole", q), ("half", q[start : start + len(q) // 2])):
            how = a.align(p, y)
            if how is not None and how[2] <= min(a.WRONG, errors + 0.02):
                got[kind].append(len(np.intersect1d(a.keys_of(p)[0], a.keys_of(y)[0])) > 0)
    assert len(got["whole"]) >= 40 and np.mean(got["whole"]) >= least and np.mean(got["half"]) >= min(least, 0.9)


def test_contested(spark, monkeypatch):
    """Clips and noisy copies of long recordings whose bucket holds other melodies, too."""
    same = tune(50, 40)
    rows = []
    for k in range(6):  # six recordings share a passage and are else unlike
        x = np.concatenate([same, tune(60 + k, 300)])
        clip = x[-5 * a.RATE :]
        rows += [(10 * k, x), (10 * k + 1, np.concatenate([same, clip])), (10 * k + 2, clip)]
    df = spark.createDataFrame([(i, a.write_wav(x, a.RATE)) for i, x in rows], "id long, audio binary")
    for block in (256, 2):
        monkeypatch.setattr(groups, "BLOCK", block)
        got = {r.id: r for r in a.classes(df).collect()}
        prints = {i: np.frombuffer(got[i].print, "<u4") for i in got}
        up = {i: i for i in got}
        for i in sorted(got):
            for j in sorted(got):
                how = a.align(prints[i], prints[j]) if i < j else None
                if how is not None and how[2] <= a.WRONG:
                    x, y = min(up[i], up[j]), max(up[i], up[j])
                    up = {k: x if v == y else v for k, v in up.items()}
        assert {i: got[i].class_id for i in got} == up
        assert all(up[10 * k + 2] == up[10 * k] for k in range(6))


def test_every_row_stays(spark):
    """Different recordings under one id or without id, and repeated rows, are rows of their own."""
    rng = np.random.default_rng(3)
    tune = lambda: a.write_wav(np.sin(np.cumsum(np.repeat(2 * np.pi * rng.integers(200, 900, 60) / a.RATE, a.NOTE))) * 0.5, a.RATE)
    tunes = [tune() for _ in range(8)]
    rows = [(None, tunes[0]), (None, tunes[1]), (None, tunes[0]), (7, tunes[2]), (7, tunes[3]), (7, tunes[3]), (7, b"x"), (None, None), (1, tunes[0]), (2, tunes[4]), (3, tunes[4]), (3, None)]
    got = a.classes(spark.createDataFrame(rows, "id long, audio binary")).collect()
    assert len(got) == len(rows)
    key = lambda r: str(r)
    want = [(None, 1), (None, None), (None, 1), (7, 7), (7, 7), (7, 7), (7, 7), (None, None), (1, 1), (2, 2), (3, 2), (3, 3)]
    assert sorted(((r.id, r.class_id) for r in got), key=key) == sorted(want, key=key)
    assert len({r.class_row for r in got}) == 8


def test_periodic_hour():
    """Two alternating items over an hour: votes are counted in bounded memory."""
    import tracemalloc

    x = np.tile(np.array([5, 9], np.uint32), 7000)
    tracemalloc.start()
    assert a.align(x, x)[0] == 0 and a.align(x, x[1:])[2] == 0
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()


def test_near_copies_are_gathered_once(spark, monkeypatch):
    """Keys of near copies that few keys have made one component already are not joined again; what else shares a key is."""
    r = np.random.default_rng(5)
    base = r.normal(size=40)
    rows = [(i, (base + 0.06 * r.normal(size=40)).tolist()) for i in range(30)] + [(100 + i, r.normal(size=40).tolist()) for i in range(10)]
    rows = spark.createDataFrame(rows, "id long, vector array<double>")
    joined, cut = [], groups.cut

    def counting(df, name="step"):
        out = cut(df, name)
        joined.append(out.count() if name == "members" else 0)
        return out

    monkeypatch.setattr(groups, "cut", counting)
    got = {x.id: x.class_id for x in a.classes(a.render(rows)).collect()}
    assert got == {i: 0 if i < 30 else i for i in got} and len(got) == 40
    assert sum(joined) < 300  # thirty near copies share hundreds of keys
