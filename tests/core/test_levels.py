"""Ranks under inserted edges against a plain computation after every batch."""

import random

import pytest

from lexiloom.operators import levels
from lexiloom.storage import step


def plain(edges, nodes):
    """id -> (rank, settled) by definition."""
    up = {i: set() for i in nodes}
    for a, b in edges:
        up[b].add(a)
    done, rest = {}, set(nodes)
    while ready := {i for i in rest if up[i] <= set(done)}:
        done.update({i: max((done[p] + 1 for p in up[i]), default=0) for i in ready})
        rest -= ready
    return {i: (r, True) for i, r in done.items()} | {i: (max((done[p] + 1 for p in up[i] if p in done), default=None), False) for i in rest}


def merged(known, change):
    return step(known.join(change.rows, "id", "left_anti").unionByName(change.rows), "known")


@pytest.mark.parametrize("seed,cycles", [(1, 0.0), (2, 0.03)])
def test_random_inserts(spark, seed, cycles):
    rng = random.Random(seed)
    names = [f"n{i:02}" for i in range(70)]
    edges, nodes = set(), set()
    known = spark.createDataFrame([], levels.LEVEL)
    sizes = [1, 1, 10, 60, 180] if not cycles else [1, 8, 40, 1, 60]
    for size in sizes:
        new = set()
        for _ in range(size):
            a, b = sorted(rng.sample(range(70), 2))
            new.add((names[b], names[a]) if rng.random() < cycles else (names[a], names[b]))
        old = spark.createDataFrame(sorted(edges), "parent string, child string")
        change = levels.insert_edges(known, old, spark.createDataFrame(sorted(new), "parent string, child string"))
        before = {r.id: (r.rank, r.settled) for r in known.collect()}
        known = merged(known, change)
        edges |= new
        nodes |= {x for e in new for x in e}
        want = plain(edges, nodes)
        assert {r.id: (r.rank, r.settled) for r in known.collect()} == want
        assert known.count() == len(want)
        differ = {i for i in want if want[i] != before.get(i)}
        rows = {r.id for r in change.rows.collect()}
        assert differ <= rows
        if not cycles:
            assert rows == differ
            assert change.walked <= len(differ) * max(1, change.rounds)


def test_whole_graph(spark):
    rng = random.Random(5)
    for back in (0.0, 0.1):
        edges = {tuple(f"n{x}" for x in (sorted(p) if rng.random() >= back else sorted(p, reverse=True))) for p in (rng.sample(range(30), 2) for _ in range(45))}
        df = spark.createDataFrame(sorted(edges), "parent string, child string")
        alone = spark.createDataFrame([("alone",)], "id string")
        want = plain(edges, {x for e in edges for x in e} | {"alone"})
        assert {r.id: (r.rank, r.settled) for r in levels.levels(alone, df).collect()} == want


def test_far_nodes_are_not_walked(spark):
    """An insert at the end of a long chain touches its end only; one that changes no rank touches nothing but itself."""
    chain = [(f"c{i:03}", f"c{i + 1:03}") for i in range(60)]
    edges = spark.createDataFrame(chain, "parent string, child string")
    known = spark.createDataFrame([(f"c{i:03}", i, True) for i in range(61)], levels.LEVEL)
    insert = lambda *e: levels.insert_edges(known, edges, spark.createDataFrame(list(e), "parent string, child string"))
    assert insert(("c000", "c030")).rows.count() == 0
    assert {tuple(r) for r in insert(("c060", "d")).rows.collect()} == {("d", 61, True)}
    late = insert(("x", "c059"))
    assert {tuple(r) for r in late.rows.collect()} == {("x", 0, True)} and late.walked == 0
    loop = insert(("c058", "c056"))
    assert {tuple(r) for r in loop.rows.collect()} == {("c056", 56, False)} | {(f"c{i:03}", None, False) for i in range(57, 61)}
    assert insert(("c001", "c001")).rows.where("settled").count() == 0


def test_new_leaves_end_a_round(spark, monkeypatch):
    """Below new nodes that no edge leads from there is nothing: the graph's edges are not read again for them."""
    reads = []
    monkeypatch.setattr(levels, "_asked", lambda edges, front, now, run=levels._asked: (reads.append(1), run(edges, front, now))[1])
    edges = spark.createDataFrame([("a", "b")], "parent string, child string")
    known = spark.createDataFrame([("a", 0, True), ("b", 1, True)], levels.LEVEL)
    change = levels.insert_edges(known, edges, spark.createDataFrame([("b", "x"), ("a", "x"), ("y", "z")], "parent string, child string"))
    assert {(r.id, r.rank, r.settled) for r in change.rows.collect()} == {("x", 2, True), ("y", 0, True), ("z", 1, True)}
    assert (change.walked, change.rounds, len(reads)) == (2, 1, 1)
