"""Single edges on the forest of classes against a plain replay."""

import random
from collections import defaultdict

import pytest

from lexiloom.operators import forest


def plain(edges, ranks, classes, rows, keep=False):
    """The rules in plain sets: edges set, ranks and classes dicts (changed), rows (u, v, pred); returns the expert's edges."""
    asked = []
    for u, v, pred in rows:
        for x in (u, v):
            classes.setdefault(x, x)
        if pred == 1 or keep:
            edges.add((u, v))
        bu, bv = classes[u], classes[v]
        ru, rv = ranks.get(bu, 0), ranks.get(bv, 0)
        held = defaultdict(set)
        for n, b in classes.items():
            held[b].add(n)
        if pred == 1 and bu != bv:
            if ru != rv:
                win, lose = (bu, bv) if ru > rv else (bv, bu)
                classes.update(dict.fromkeys(held[lose], win))
            else:
                in_u, in_v = held[bu] or {bu}, held[bv] or {bv}
                parents = {a for a, b in edges if b in in_v}
                children = {b for a, b in edges if a in in_u}
                classes.update(dict.fromkeys(parents, bu))
                classes.update(dict.fromkeys(children, bv))
        elif pred == 0 and bu == bv:
            near = lambda n: ({b for a, b in edges if a == n}, {a for a, b in edges if b == n})
            own = near(v)
            classes.update({n: n for n in held[bu] if near(n) != own})
            asked.append((u, v))
    return asked


@pytest.mark.parametrize("seed,mix", [(1, 0.2), (2, 0.6)])
def test_random_replay(spark, seed, mix):
    rng = random.Random(seed)
    names = [f"n{i:02}" for i in range(24)]
    edges = {tuple(sorted(rng.sample(names[:16], 2))) for _ in range(14)}
    ranks = {n: rng.randint(0, 9 if mix < 0.5 else 2) for n in names[:20]}
    rows = [(*rng.sample(names, 2), int(rng.random() > 0.25)) for _ in range(24 if mix < 0.5 else 12)]
    start = spark.createDataFrame(sorted(edges), "parent string, child string")
    none = lambda schema: spark.createDataFrame([], schema)
    replay = forest.Replay(start, spark.createDataFrame(list(ranks.items()), "id string, rank int"), none(forest.LABEL), none(forest.LINK))
    cut = len(rows) // 2
    replay.run(rows[:cut])  # a second round sees what the first has left
    replay.run(rows[cut:])
    classes = {}
    asked = plain(edges, ranks, classes, rows)
    assert {r.id: r.block for r in forest.classes(replay.after("labels"), replay.after("links")).collect()} == classes
    assert {(r.parent, r.child) for r in replay.after("edges").collect()} == edges
    assert [tuple(r) for f in replay.new["expert"] for r in f.collect()] == asked
    assert replay.barriers > 0


def test_joining_writes_one_row(spark):
    """Whatever the classes hold."""
    for n in (10, 3000):
        labels = spark.range(n).selectExpr("concat('m', id) as id", "if(id % 2 = 0, 'a', 'b') as name", "cast(-1 as long) as seq")
        ranks = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "id string, rank int")
        replay = forest.Replay(spark.createDataFrame([], "parent string, child string"), ranks, labels, spark.createDataFrame([], forest.LINK))
        replay.run([("m0", "m1", 1), ("m1", "c", 1)])
        assert sum(f.count() for f in replay.new["links"]) == 2
        assert sum(f.count() for f in replay.new["labels"]) == 1  # the new node c
        got = forest.classes(replay.after("labels"), replay.after("links"))
        assert got.where("block = 'c'").count() == n + 1


@pytest.mark.parametrize("seed,same,rejected", [(4, 3, 0.1), (5, 0, 0)])
def test_table_replay(spark, monkeypatch, seed, same, rejected):
    """A table of edges in windows: tasks replay components up to an edge that moves members. ``same``: ranks that are shared."""
    rng = random.Random(seed)
    monkeypatch.setattr(forest, "ROUND", 3)
    monkeypatch.setattr(forest, "WINDOW", 20)
    names = [f"n{i:03}" for i in range(40)]
    edges = {tuple(sorted(rng.sample(names, 2))) for _ in range(25)}
    ranks = {n: i if i >= same else 0 for i, n in enumerate(rng.sample(names, 36))}
    rows = [(i, *rng.sample(names, 2), int(rng.random() >= rejected)) for i in range(30)]
    # some are in classes already, of names that are no labelled nodes
    classes = {n: rng.choice(names[28:]) for n in names[:16]}
    labels = spark.createDataFrame([(n, b, -1) for n, b in classes.items()], forest.LABEL)
    start = spark.createDataFrame(sorted(edges), "parent string, child string")
    replay = forest.Replay(start, spark.createDataFrame(list(ranks.items()), "id string, rank int"), labels, spark.createDataFrame([], forest.LINK))
    single = []
    monkeypatch.setattr(replay, "_round", lambda part, run=replay._round: (single.append(len(part)), run(part)))
    replay.run_table(spark.createDataFrame(rng.sample(rows, len(rows)), "seq long, u string, v string, pred int"))
    asked = plain(edges, ranks, classes, [r[1:] for r in rows])
    assert {r.id: r.block for r in forest.classes(replay.after("labels"), replay.after("links")).collect()} == classes
    assert {(r.parent, r.child) for r in replay.after("edges").collect()} == edges
    assert [tuple(r) for f in replay.new["expert"] for r in f.collect()] == asked
    assert replay.seen == len(rows)
    assert rejected or sum(single) == 0  # without such an edge nothing passes through the driver


def counted(frame):
    """The frame, and an accumulator of how many of its rows have been read."""
    read = frame.sparkSession.sparkContext.accumulator(0)

    def rows(batches):
        for b in batches:
            read.add(b.num_rows)
            yield b

    return frame.coalesce(1).mapInArrow(rows, frame.schema), read


def test_windows_look_ranks_up_once(spark, monkeypatch):
    """However many windows a table has; nodes that come later do not need a row of their own."""
    monkeypatch.setattr(forest, "ROUND", 2)
    monkeypatch.setattr(forest, "WINDOW", 8)
    names = [f"n{i:02}" for i in range(30)]
    held = {n: i for i, n in enumerate(names)}
    ranks, read = counted(spark.createDataFrame([*held.items()], "id string, rank int"))
    rows = [(i, names[i], names[i + 1 + i % 3], 1) for i in range(26)]
    replay = forest.Replay(spark.createDataFrame([], "parent string, child string"), ranks, *[spark.createDataFrame([], x) for x in (forest.LABEL, forest.LINK)])
    replay.run_table(spark.createDataFrame(rows, "seq long, u string, v string, pred int"))
    classes = {}
    plain(set(), held, classes, [r[1:] for r in rows])
    assert {r.id: r.block for r in forest.classes(replay.after("labels"), replay.after("links")).collect()} == classes
    assert read.value == len(names)


@pytest.mark.parametrize("pred", [0, 1])
def test_moves_read_edges_once(spark, pred):
    """Where members move, the edges are read in one pass."""
    rows = [("a", "b"), ("b", "c"), ("a", "d"), ("e", "d"), ("d", "c")]
    edges, read = counted(spark.createDataFrame([(*e, 0) for e in rows], forest.EDGES))
    classes = {"a": "x", "b": "x", "d": "x", "c": "y" if pred else "x"}
    labels = spark.createDataFrame([(n, b, -1) for n, b in classes.items()], forest.LABEL)
    replay = forest.Replay(edges, spark.createDataFrame([], "id string, rank int"), labels, spark.createDataFrame([], forest.LINK))
    replay.run([("b", "c", pred)])
    moved = replay.new["labels"][-1]
    got = {r.id: r.name for r in moved.collect()}
    plain(set(rows), {}, classes, [("b", "c", pred)])
    assert got == {n: classes[n] for n in got} and replay.barriers == 1
    assert {r.id: r.block for r in forest.classes(replay.after("labels"), replay.after("links")).collect()} == classes
    assert read.value == len(rows)
