import random

import pytest

from lexiloom.operators import graph as g
from lexiloom.operators import refine as r


def frame(spark, edges):
    return spark.createDataFrame(edges, "parent string, child string")


def ranks_of(spark, edges, nodes=()):
    n = spark.createDataFrame([(x,) for x in nodes], "id string")
    e = frame(spark, edges)
    return {x.id: x.rank for x in g.ranks(g.nodes_of(n, e), e).collect()}


def plain_ranks(edges, nodes=()):
    """Longest path from a root, by definition."""
    ids = {x for e in edges for x in e} | set(nodes)
    up = {i: {a for a, b in edges if b == i} for i in ids}
    done = {}
    while True:
        new = {i for i in ids if i not in done and up[i] <= set(done)}
        if not new:
            break
        level = {i: max((done[p] + 1 for p in up[i]), default=0) for i in new}
        done.update(level)
    return done | {i: max(done[p] for p in up[i] if p in done) + 1 for i in ids if i not in done and up[i] & set(done)}


def plain_refine(edges, ranks):
    blocks = {}
    for i, k in ranks.items():
        blocks.setdefault(k, set()).add(i)
    top = max(ranks.values())
    parts = [blocks[k] for k in sorted(blocks)]
    kids = {}
    for a, b in edges:
        kids.setdefault(a, set()).add(b)
    for i in range(top + 1):
        out = []
        for c in parts:
            split = None
            if ranks[next(iter(c))] > i:
                for u in sorted(x for x, k in ranks.items() if k == i):
                    inside = c & kids.get(u, set())
                    if inside and inside != c:
                        split = [inside, c - inside]
                        break
            out += split or [c]
        parts = out
    return {x: min(c) for c in parts for x in c}


def random_dag(seed, n=14):
    x = random.Random(seed)
    return sorted({(f"n{a:02}", f"n{b:02}") for a, b in (sorted(x.sample(range(n), 2)) for _ in range(n + x.randint(0, n)))})


def test_ranks_known(spark):
    assert ranks_of(spark, [("a", "b"), ("b", "c"), ("a", "c")], ["z"]) == {"a": 0, "b": 1, "c": 2, "z": 0}
    assert ranks_of(spark, [("x", "y"), ("y", "x")]) == {}
    assert ranks_of(spark, [("r", "x"), ("x", "y"), ("y", "x")]) == {"r": 0, "x": 1}


@pytest.mark.parametrize("seed", [1, 2])
def test_random(spark, seed):
    edges = random_dag(seed)
    want = plain_ranks(edges)
    got = ranks_of(spark, edges)
    assert got == want and all(got[b] > got[a] for a, b in edges)
    e = frame(spark, edges)
    ranks = spark.createDataFrame(list(got.items()), "id string, rank int")
    blocks, small = r.offline_refine(e, ranks)
    blocks = {x.id: x.block for x in blocks.collect()}
    assert blocks == plain_refine(edges, got)
    assert {tuple(x) for x in small.collect()} == {(blocks[a], blocks[b]) for a, b in edges if blocks[a] != blocks[b]}
    full = {x.id: x.block for x in r.offline_refine(e, ranks, "full")[0].collect()}
    ups = {i: frozenset(full[a] for a, b in edges if b == i) for i in full}
    for i in full:
        for j in full:
            if full[i] == full[j]:
                assert got[i] == got[j] and ups[i] == ups[j]


def test_refine_known(spark):
    def run(edges):
        ranks = spark.createDataFrame(list(plain_ranks(edges).items()), "id string, rank int")
        blocks, small = r.offline_refine(frame(spark, edges), ranks)
        return {x.id: x.block for x in blocks.collect()}, sorted(map(tuple, small.collect()))

    assert run([("a", "c"), ("b", "c"), ("b", "d")]) == ({"a": "a", "b": "a", "c": "c", "d": "d"}, [("a", "c"), ("a", "d")])
    assert run([("a", "c"), ("b", "d")])[1] == [("a", "c"), ("a", "d")]
    blocks, small = r.offline_refine(frame(spark, []), spark.createDataFrame([], "id string, rank int"))
    assert blocks.count() == 0 and small.count() == 0
    alone = spark.createDataFrame([("p", 0), ("q", 0)], "id string, rank int")
    blocks, small = r.offline_refine(frame(spark, []), alone)
    assert {x.block for x in blocks.collect()} == {"p"} and small.count() == 0


def state(spark, edges, ranks, classes):
    return r.State(frame(spark, edges), spark.createDataFrame(ranks, "id string, rank int"), spark.createDataFrame(classes, "id string, block string"), spark.createDataFrame([], "u string, v string"))


def test_online(spark):
    s = state(spark, [("a", "b")], [("a", 0), ("b", 1)], [("a", "a"), ("b", "b")])
    out = r.online_refine(s, [("a", "b")], 1)
    assert {x.id: x.block for x in out.classes.collect()} == {"a": "b", "b": "b"}  # the lower rank joins the higher
    out = r.online_refine(r.empty_state(spark), [("u", "v")], 1)
    # equal ranks: parents of v's class join u's class, then children of u's class join v's
    assert {x.id: x.block for x in out.classes.collect()} == {"u": "u", "v": "v"}
    s = state(spark, [("p", "x"), ("p", "y"), ("x", "k")], [("p", 0), ("x", 1), ("y", 1), ("k", 2)], [("p", "p"), ("x", "x"), ("y", "x"), ("k", "k")])
    out = r.online_refine(s, [("x", "y")], 0)
    assert {x.id: x.block for x in out.classes.collect()} == {"p": "p", "x": "x", "y": "x", "k": "k"}
    assert [tuple(x) for x in out.expert.collect()] == [("x", "y")]
    assert ("x", "y") not in {tuple(e) for e in out.edges.collect()}
    kept = r.online_refine(s, [("y", "x")], 0, keep_rejected=True)
    assert ("y", "x") in {tuple(e) for e in kept.edges.collect()}
    assert r.online_refine(s, [], 1) is s


def test_closure_and_merge(spark):
    e = frame(spark, [("a", "b"), ("b", "c"), ("c", "a"), ("d", "c")])
    start = spark.createDataFrame([("a",), ("d",)], "id string")
    got = {tuple(x) for x in g.closure(e, start).collect()}
    assert got == {("a", x) for x in "abc"} | {("d", x) for x in "abc"}
    assert ("d", "d") in {tuple(x) for x in g.closure(e, start, include_self=True).collect()}
    assert {tuple(x) for x in g.closure(e, start, down=False).collect()} == {("a", "c"), ("a", "b"), ("a", "a"), ("a", "d")}
    n, m = g.merge_graphs((start, e), (start, e))
    assert n.count() == 4 and m.count() == 4
    assert {x.id: x.degree for x in g.in_degree(n, m).collect()} == {"a": 1, "b": 1, "c": 2, "d": 0}


def test_deep_closure(spark):
    """Rounds grow with the logarithm of the depth; each pair is found once."""
    n = 3000
    chain = spark.range(n).selectExpr("concat('c', id) as parent", "concat('c', id + 1) as child").unionByName(frame(spark, [("c1", "c7"), ("c2500", "c2400")]))
    start = spark.createDataFrame([("c0",), ("c2990",)], "id string")
    got, rounds = g.closure_in_rounds(chain, start)
    pairs = [tuple(r) for r in got.collect()]
    want = {("c0", f"c{i}") for i in range(1, n + 1)} | {("c2990", f"c{i}") for i in range(2991, n + 1)}
    assert len(pairs) == len(set(pairs)) and set(pairs) == want and rounds < 20


@pytest.mark.parametrize("include_self", [False, True])
def test_least_reachable(spark, include_self):
    x = random.Random(7)
    ids = [f"n{i:02}" for i in range(20)]
    edges = sorted({tuple(x.sample(ids, 2)) for _ in range(24)})  # with cycles
    items = [(i, x.choice("abcdefgh")) for i in ids for _ in range(x.randint(0, 3))]
    down = {i: {i} if include_self else set() for i in ids}
    for i in ids:
        todo = [i]
        while todo:
            for a, b in edges:
                if a == todo[0] and b not in down[i]:
                    down[i].add(b)
                    todo.append(b)
            todo.pop(0)
    start = spark.createDataFrame([(i,) for i in ids[:12]], "id string")
    got = g.least_reachable(frame(spark, edges), start, spark.createDataFrame(items, "id string, item string"), 3, include_self=include_self)
    want = {i: sorted({v for j, v in items if j in down[i]})[:3] for i in ids[:12]}
    assert {r.start: r["items"] for r in got.collect()} == {i: v for i, v in want.items() if v}


def test_deep_ranks(spark):
    """A long chain takes jobs by the logarithm of its length; side paths and cycles are as by definition."""
    n = 100_000
    chain = spark.range(n).selectExpr("concat('c', id) as parent", "concat('c', id + 1) as child")
    more = [("c10", "x1"), ("x1", "x2"), ("x2", "x3"), ("x3", "c12"), ("y", "c50000"), ("l1", "l2"), ("l2", "l1"), ("l2", "m"), ("c5", "k"), ("k", "k2"), ("k2", "k")]
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("deep", "ranks")
    got = {r.id: r.rank for r in g.ranks(None, chain.unionByName(frame(spark, more))).collect()}
    jobs = len(tracker.getJobIdsForGroup("deep"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs < 150  # joins that look at sizes first count as jobs of their own
    assert {got[f"c{i}"] for i in range(12)} == set(range(12)) and all(got[f"c{i}"] == i + 2 for i in (12, 13, 49_999, 50_000, n))
    assert got["x3"] == 13 and got["y"] == 0 and got["k"] == 6 and not {"k2", "l1", "l2", "m"} & set(got)


def test_ranks_below_roots_are_not_joined(spark, monkeypatch):
    """What lies below roots over chains has its rank by its distance: no edge of a root's name is left to be met."""
    written = []
    monkeypatch.setattr(g, "step", lambda df, name="step", run=g.step: (lambda out: (written.append((name, out)), out)[1])(run(df, name)))
    rows = [("r", "m")] + [("m", f"c{i}") for i in range(50)] + [(f"c{i}", f"d{i}") for i in range(50)] + [("r", f"d{i}") for i in range(50)] + [("d0", "e"), ("d1", "e")]
    found = {r.id: r.rank for r in g.ranks(None, spark.createDataFrame(rows, "parent string, child string")).collect()}
    assert found == {"r": 0, "m": 1, "e": 4} | {f"c{i}": 2 for i in range(50)} | {f"d{i}": 3 for i in range(50)}
    met = [out for name, out in written if name == "contracted"][1]
    assert met.count() == 2 and not met.where("parent = 'r'").count()  # of the 102 edges into nodes of several parents
