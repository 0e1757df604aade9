"""Longest-path ranks kept under inserted edges: only nodes whose rank changes are walked.

A table of levels is (id, rank, settled). A settled node's rank is the longest path from a root. A node on or behind a cycle is
not settled: its rank is the greatest of its settled parents plus one, or null, and counts for no other node.

Inserted edges raise their heads where the tail's rank asks for it; a raised node raises its children, and so on, until
ranks hold. On a cycle every node is raised without end: after 8, 16, 32, ... rounds the raised nodes are peeled among
themselves, and what cannot be peeled lies on or behind a cycle. Those nodes, the heads of edges from unsettled tails, and all that
is reached from either are ranked anew, with the ranks around them as they are.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import step
from . import forest, graph

LEVEL = "id string, rank int, settled boolean"


@dataclass
class Change:
    """The rows of the levels that changed (new nodes among them), how many rows were read as fronts, and in how many rounds."""

    rows: DataFrame
    walked: int
    rounds: int


def levels(nodes: DataFrame | None, edges: DataFrame) -> DataFrame:
    """Levels of a whole graph."""
    edges = step(edges.select("parent", "child").distinct(), "edges")
    found = step(graph.ranks(nodes, edges, written=True), "ranks")
    every = graph.nodes_of(nodes, edges).join(found, "id", "left")
    # a node is settled when no parent of it is unsettled; the ranks say so: every parent has a rank, all below its own
    known = found.select(F.col("id").alias("parent"), F.col("rank").alias("up"))
    bad = edges.join(known, "parent", "left").join(found.select(F.col("id").alias("child"), "rank"), "child", "left")
    bad = step(bad.where("up IS NULL OR rank IS NULL OR up >= rank").select(F.col("child").alias("id")).distinct(), "bad")
    if not bad.isEmpty():
        bad = graph.closure(edges, bad, include_self=True).select("id").distinct()
    return every.join(bad.withColumn("open", F.lit(True)), "id", "left").select("id", F.col("rank").cast("int").alias("rank"), (F.col("open").isNull() & F.col("rank").isNotNull()).alias("settled"))


def insert_edges(known: DataFrame, edges: DataFrame, new: DataFrame) -> Change:
    """The change of the levels ``known`` of the graph ``edges`` by the edges ``new``; both tables of edges have no row twice.

    Ends of new edges that are not known are new nodes. Edges that the graph has already change nothing.
    """
    new = step(new.select("parent", "child").distinct(), "new")
    every = edges.select("parent", "child").unionByName(new)
    ends = new.select(F.col("parent").alias("id"), F.lit(True).alias("above")).unionByName(new.select(F.col("child").alias("id"), F.lit(False).alias("above")))
    # the ends with their levels, once; nothing is below a new node that no edge leads from
    ends = ends.groupBy("id").agg(F.max("above").alias("above")).join(known.select("id", "rank", "settled", F.lit(True).alias("old")), "id", "left")
    at = step(ends.select("id", F.when(F.col("old"), F.col("rank")).otherwise(0).cast("int").alias("rank"), F.when(F.col("old"), F.col("settled")).otherwise(True).alias("settled"), F.col("old").isNull().alias("fresh"), (F.col("old").isNull() & ~F.col("above")).alias("leaf")), "ends")
    fresh = at.where("fresh").select("id", "rank", "settled")
    leaf = F.lit(False).alias("leaf")
    before = known.select("id", "rank", "settled", leaf).unionByName(at.where("fresh").select("id", "rank", "settled", "leaf"))
    front = _asked(new, at, at)
    raised, walked, rounds = front.limit(0).drop("leaf"), 0, 0
    check = 8
    cyclic = None
    while True:
        front = step(front, "front")
        n = front.count()
        if not n:
            break
        walked, rounds = walked + n, rounds + 1
        last = front.drop("leaf")
        raised = last if rounds == 1 else step(raised.join(last, "id", "left_anti").unionByName(last), "raised")
        if rounds == check:
            check *= 2
            stuck = _unpeeled(raised.where("settled").select("id"), every)
            if not stuck.isEmpty():
                cyclic = stuck
                break
        front = front.where("NOT leaf")
        if front.isEmpty():  # every edge would be read to find nothing
            break
        now = before.join(raised.select("id", F.col("rank").alias("more")), "id", "left").select("id", F.coalesce("more", "rank").alias("rank"), "settled", "leaf")
        front = _asked(every, front, now)
    before = before.drop("leaf")
    unsettled = at.where("NOT settled")
    start = None if cyclic is None else cyclic
    if not unsettled.isEmpty():
        open_heads = new.join(unsettled.select(F.col("id").alias("parent")), "parent", "left_semi").select(F.col("child").alias("id")).distinct()
        start = open_heads if start is None else open_heads.unionByName(start).distinct()
    if start is not None:
        start = step(start.join(before.where("settled"), "id", "left_semi"), "start")
    if start is None or start.isEmpty():
        return Change(step(raised.unionByName(fresh.join(raised, "id", "left_anti")), "levels"), walked, rounds)
    region = step(graph.closure(every, start, include_self=True).select("id").distinct(), "region")
    if cyclic is not None:  # values that went round a cycle are no ranks: what was raised is ranked anew as well
        region = step(region.unionByName(raised.select("id")).distinct(), "region")
    else:
        before = before.join(raised, "id", "left_anti").unionByName(raised)
    anew, met, more = _anew(region, every, before)
    rest = raised.join(region, "id", "left_anti").unionByName(fresh)
    return Change(step(anew.unionByName(rest.dropDuplicates(["id"]).join(region, "id", "left_anti")), "levels"), walked + met, rounds + more)


def _asked(edges: DataFrame, front: DataFrame, now: DataFrame) -> DataFrame:
    """The children that the front's settled nodes ask for a higher rank than they have now (id, rank, settled, leaf)."""
    tails = front.where("settled").select(F.col("id").alias("parent"), (F.col("rank") + 1).alias("up"))
    asked = edges.join(tails, "parent").groupBy(F.col("child").alias("id")).agg(F.max("up").cast("int").alias("up"))
    return asked.join(now, "id").where("rank IS NULL OR up > rank").select("id", F.col("up").alias("rank"), "settled", "leaf")


def _unpeeled(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes on or behind a cycle among ``nodes``."""
    none = nodes.sparkSession.createDataFrame([], LEVEL)
    return _anew(nodes, edges, none)[0].where("NOT settled").select("id")


def _anew(region: DataFrame, edges: DataFrame, before: DataFrame) -> tuple[DataFrame, int, int]:
    """Levels of the region's nodes from those around it: nodes are peeled once all parents are."""
    into = edges.join(region.withColumnRenamed("id", "child"), "child", "left_semi")
    marked = into.join(region.select(F.col("id").alias("parent"), F.lit(True).alias("inner")), "parent", "left")
    outer = marked.where("inner IS NULL").join(before.withColumnRenamed("id", "parent"), "parent")
    inner = step(marked.where("inner").select("parent", "child"), "inner")
    # a parent outside that is not settled never closes
    around = outer.groupBy(F.col("child").alias("id")).agg(F.max(F.when(F.col("settled"), F.col("rank") + 1)).alias("base"), F.count_if(~F.col("settled")).alias("open"))
    held = inner.groupBy(F.col("child").alias("id")).agg(F.count("*").alias("inside"))
    zero = F.lit(0).cast("long")
    counts = region.join(around, "id", "left").join(held, "id", "left").select("id", (F.coalesce("open", zero) + F.coalesce("inside", zero)).alias("open"), F.col("base").cast("int").alias("base"))
    done, walked, rounds = [], 0, 0
    while True:
        counts = step(counts, "counts")
        ready = counts.where("open = 0").select("id", F.coalesce("base", F.lit(0)).alias("rank"))
        n = ready.count()
        if not n:
            break
        walked, rounds = walked + n, rounds + 1
        done.append(ready)
        if len(done) > 16:
            done = [step(forest.union(done), "done")]
        met = inner.join(ready.withColumnRenamed("id", "parent"), "parent").groupBy(F.col("child").alias("id")).agg(F.count("*").alias("n"), (F.max("rank") + 1).alias("up"))
        counts = counts.where("open > 0").join(met, "id", "left").select("id", (F.col("open") - F.coalesce("n", zero)).alias("open"), F.greatest("base", "up").cast("int").alias("base"))
    left = counts.select("id", F.col("base").alias("rank"), F.lit(False).alias("settled"))
    if done:
        left = left.unionByName(forest.union(done).select("id", "rank", F.lit(True).alias("settled")))
    return step(left, "anew"), walked, rounds

