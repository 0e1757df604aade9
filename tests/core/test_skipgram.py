"""Counted pairs, vectors in shards, and walks with a bias."""

from collections import Counter

import numpy as np
import pytest

from lexiloom.operators import embed, skipgram


def _two_communities(n, seed=3):
    """Walks of which each stays within one of two groups of n nodes, but for a step in forty."""
    r = np.random.default_rng(seed)
    rows = []
    for k in range(600):
        c, path = "ab"[k % 2], []
        for _ in range(12):
            c = "ba"[c == "b"] if r.random() < 1 / 40 else c
            path.append(f"{c}{r.integers(n)}")
        rows.append((path,))
    return rows


def test_context_pairs(spark):
    rows = [(["x", "y", "x", "z"],), (["y"],), ([],), (None,), (["x", "y"],)]
    want = Counter()
    for (p,) in rows:
        for i, a in enumerate(p or []):
            want.update((a, b) for j, b in enumerate(p) if i != j and abs(i - j) <= 2)
    got = skipgram.context_pairs(spark.createDataFrame(rows, "path array<string>"), 2).collect()
    assert {(r.node, r.context): r.weight for r in got} == want


@pytest.mark.parametrize("shard", [1000, 15])
def test_shards(spark, shard):
    """Whether vectors lie in one shard or in several that rotate: all nodes have one, communities part, a rerun agrees."""
    rows = _two_communities(25) + [(["alone"],)]
    paths = spark.createDataFrame(rows, "path array<string>")
    v = {r.id: np.array(r.vector) for r in skipgram.skip_gram(paths, 8, 4, shard=shard).collect()}
    assert set(v) == {x for (p,) in rows for x in p} and all(len(x) == 8 and np.isfinite(x).all() for x in v.values())
    unit = {k: x / np.linalg.norm(x) for k, x in v.items() if k != "alone"}
    a, b = (np.array([x for k, x in sorted(unit.items()) if k[0] == c]) for c in "ab")
    within = [(m @ m.T)[np.triu_indices(len(m), 1)].mean() for m in (a, b)]
    assert min(within) > (a @ b.T).mean() + 0.3
    again = {r.id: np.array(r.vector) for r in skipgram.skip_gram(paths.repartition(5), 8, 4, shard=shard).collect()}
    assert all(np.array_equal(v[k], again[k]) for k in v)


def test_no_walks(spark):
    assert skipgram.skip_gram(spark.createDataFrame([], "path array<string>"), 4, 2).count() == 0


@pytest.mark.parametrize(("p", "q"), [(0.25, 2.0), (4.0, 0.5)])
def test_biased(spark, p, q):
    """Second steps from the hub have the shares that the weights say; walks keep to edges and to their length."""
    pairs = [("s", "h"), ("h", "s"), ("h", "x"), ("h", "y"), ("h", "z"), ("s", "x"), ("x", "h"), ("y", "h")]
    edges = spark.createDataFrame(pairs, "parent string, child string")
    nodes = spark.createDataFrame([("s",), ("alone",)], "id string")
    paths = [r.path for r in embed.walks(nodes, edges, 4, 6000, p, q).collect()]
    assert len(paths) == 12_000 and max(map(len, paths)) == 4 and paths.count(["alone"]) == 6000
    assert all(e in pairs for x in paths for e in zip(x, x[1:], strict=False))
    assert all(len(x) == 4 or x[-1] in ("z", "alone") for x in paths)
    second = [x[2] for x in paths if x[:2] == ["s", "h"]]
    weights = {"s": 1 / p, "x": 1.0, "y": 1 / q, "z": 1 / q}
    for node, w in weights.items():
        assert abs(second.count(node) / len(second) - w / sum(weights.values())) < 0.04
    again = [r.path for r in embed.walks(nodes, edges.repartition(3), 4, 6000, p, q).collect()]
    assert sorted(again) == sorted(paths)


def test_nodes_without_pairs_are_in_no_shard(spark, monkeypatch):
    """They get a vector, but no round carries them."""
    from lexiloom.operators import skipgram as own

    dealt = []
    monkeypatch.setattr(own, "_by_round", lambda counted, numbered, shards, run=own._by_round: (dealt.append((numbered.count(), shards)), run(counted, numbered, shards))[1])
    paths = spark.createDataFrame([(["a", "b"],)] + [([f"n{i}"],) for i in range(30)], "path array<string>")
    found = {r.id: r.vector for r in own.skip_gram(paths, 4, 2, epochs=1, passes=1, shard=8).collect()}
    assert set(found) == {"a", "b"} | {f"n{i}" for i in range(30)}
    assert all(len(v) == 4 and any(v) for v in found.values())
    assert dealt == [(2, 1)]
