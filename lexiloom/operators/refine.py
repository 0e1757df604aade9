"""Partition refinement of a ranked graph, in bulk and by single edges."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import step, step_path
from . import forest, graph


def offline_refine(edges: DataFrame, ranks: DataFrame, mode: str = "by_rank", written: bool = False) -> tuple[DataFrame, DataFrame]:
    """(blocks (id, block named by its least id), compressed edges).

    ``by_rank``: blocks start as ranks; at rank i each block of higher rank splits once, into the children of the least
    splitting node of rank i and the others. ``full``: blocks split by their members' parent blocks until none does, the
    coarsest stable partition under its ranks. ``written``: the edges are a table of distinct rows.
    """
    edges = edges.select("parent", "child") if written else step(edges.select("parent", "child").distinct(), "edges")
    ranks = step(ranks.select("id", F.col("rank").cast("int").alias("rank")), "ranks")
    top = ranks.agg(F.max("rank")).first()[0]
    if top is None:
        return ranks.select("id", F.col("id").alias("block")), edges.limit(0)
    blocks = ranks.select("id", "rank", F.col("rank").cast("string").alias("block"))
    blocks = _full(edges, blocks) if mode == "full" else _by_rank(edges, ranks, blocks, int(top))
    named = step(graph.representatives(blocks.select("id", "block")), "blocks")
    return named, graph.collapse(edges, named)


def split_once(blocks: DataFrame, edges: DataFrame, rank: int) -> DataFrame:
    """One pass: distinct edges (parent, child) of parents of ``rank``; blocks (id, rank, block)."""
    return _split(blocks, edges, rank, lambda block, bit: F.concat(block, F.lit("."), bit))


def _split(blocks: DataFrame, edges: DataFrame, rank: int, label: Callable[[Column, Column], Column]) -> DataFrame:
    above = blocks.where(F.col("rank") > rank)
    hit = edges.join(above.select(F.col("id").alias("child"), "block"), "child")
    sizes = above.groupBy("block").agg(F.count(F.lit(1)).alias("size"))
    covered = hit.groupBy("block", "parent").agg(F.count(F.lit(1)).alias("n"))
    # written, since it is read twice and its size then says whether it can be broadcast
    splitter = step(covered.join(sizes, "block").where("n < size").groupBy("block").agg(F.min("parent").alias("by")), "splitters")
    # a member of a block that splits is met by its splitter once at most
    split = blocks.join(splitter, "block", "left")
    met = edges.join(splitter.select(F.col("by").alias("parent")).distinct(), "parent", "left_semi")
    met = met.select(F.col("child").alias("id"), F.col("parent").alias("by"), F.lit("1").alias("bit"))
    met = step(met, "met")  # a few parents' children: where its size is small, no block row is shuffled for it
    out = split.join(met, ["id", "by"], "left")
    return out.select("id", "rank", F.when(F.col("by").isNotNull(), label(F.col("block"), F.coalesce("bit", F.lit("0")))).otherwise(F.col("block")).alias("block"))


def _by_rank(edges: DataFrame, ranks: DataFrame, blocks: DataFrame, top: int) -> DataFrame:
    """Labels are digests of the splits, of one length however many; a pass writes the blocks above its rank only."""
    ranked = step(edges.join(ranks.select(F.col("id").alias("parent"), F.col("rank").alias("pr")), "parent"), "ranked")
    spark, base = edges.sparkSession, step_path(edges.sparkSession, "passes")
    shape = "id string, rank int, block string"
    # one table with a part a pass: plans do not grow with the ranks; after pass i the blocks of rank i + 1 are settled
    blocks.select("id", "rank", "block").write.parquet(f"{base}/pass=-1")
    for i in range(top):
        before = spark.read.schema(shape).parquet(f"{base}/pass={i - 1}")
        now = _split(before.where(F.col("rank") > i), ranked.where(F.col("pr") == i).select("parent", "child"), i, lambda block, bit: F.md5(F.concat(block, bit)))
        now.select("id", "rank", "block").write.parquet(f"{base}/pass={i}")
    return spark.read.schema(f"{shape}, pass int").parquet(base).where("rank = pass + 1").select("id", "rank", "block")


def _full(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    n = blocks.select("block").distinct().count()
    while True:
        # two hashes stand for a block on its way to the children, dealt by child once
        hashes = blocks.select(F.col("id").alias("parent"), *[F.xxhash64(F.lit(seed), "block").alias(f"h{seed}") for seed in (1, 2)])
        above = edges.join(hashes, "parent").select(F.col("child").alias("id"), "h1", "h2").repartition("id").distinct()
        # their sums and a count stand for the set of parent blocks, whatever its size
        sums = [F.sum(F.col(h).cast("decimal(20,0)")) for h in ("h1", "h2")]
        signature = above.groupBy("id").agg(F.concat_ws(",", F.count(F.lit(1)), *sums).alias("sig"))
        new = blocks.join(signature, "id", "left").select("id", "rank", F.md5(F.concat_ws("|", "block", F.coalesce("sig", F.lit("")))).alias("block"))
        blocks = step(new, "blocks")
        now = blocks.select("block").distinct().count()
        if now == n:
            return blocks
        n = now


@dataclass
class State:
    """The graph that single edges refine: edges (parent, child), ranks (id, rank), classes (id, block), expert (u, v)."""

    edges: DataFrame
    ranks: DataFrame
    classes: DataFrame
    expert: DataFrame


def online_refine(state: State, delta: list[tuple[str, str]], pred: int, keep_rejected: bool = False) -> State:
    """The state after the edges of ``delta``, all with one prediction.

    New ends have rank 0 and their own class. An accepted match between classes merges the lower-ranked class into the
    higher; of equal ranks, parents of v's class join u's class, then children of u's class join v's. A rejected match
    within a class makes every member a class of its own whose parents or children differ from v's, and asks an expert.
    Edges come in the order of their block's rank. A rejected edge enters the graph only with ``keep_rejected``.
    """
    spark = state.edges.sparkSession
    if not delta:
        return state
    rows = spark.createDataFrame([(i, u, v) for i, (u, v) in enumerate(delta)], "seq long, u string, v string")
    by = rows.join(state.classes.select(F.col("id").alias("u"), "block"), "u", "left").select("seq", "u", "v", F.coalesce("block", "u").alias("id"))
    order = by.join(state.ranks, "id", "left").orderBy(F.coalesce("rank", F.lit(0)), "seq").select("u", "v").collect()
    labels = state.classes.select("id", F.col("block").alias("name"), F.lit(forest.NEVER).cast("long").alias("seq"))
    replay = forest.Replay(state.edges, state.ranks, labels, spark.createDataFrame([], forest.LINK), keep_rejected=keep_rejected)
    replay.run((r.u, r.v, pred) for r in order)
    ends = rows.select(F.col("u").alias("id")).unionByName(rows.select(F.col("v").alias("id"))).distinct()
    fresh = ends.join(state.ranks, "id", "left_anti").select("id", F.lit(0).alias("rank"))
    return State(replay.after("edges").select("parent", "child").distinct(), state.ranks.select("id", "rank").unionByName(fresh), forest.classes(replay.after("labels"), replay.after("links")), forest.union([state.expert, *replay.new["expert"]]))


def empty_state(spark) -> State:
    return State(
        spark.createDataFrame([], "parent string, child string"), spark.createDataFrame([], "id string, rank int"),
        spark.createDataFrame([], "id string, block string"), spark.createDataFrame([], "u string, v string"),
    )
