"""Skip-gram with negative sampling: node vectors live in shards that rotate among tasks, none of them on the driver.

Walks become counted pairs (node, context, weight), so repeated walks cost nothing more than their counts. Nodes are dealt by hash
into shards of about ``SHARD``. In round r of an epoch, task a holds the vectors of shard a and the context vectors
of shard a + r, and streams the pairs between the two past them; no two tasks share a vector, and after as many rounds as there are
shards every pair was met once, in chunks that are gone through ``passes`` times in random order. Negatives come from the context shard at hand, by their frequency to the power 0.75.
Steps are scaled per node by the gradients it has had, so that counts and hubs cannot make them large.

Nodes without a pair never move and are in no shard: they get their first random vector and no more.
A round writes all vectors of the others, so the bytes of an epoch grow with nodes times shards; memory of a task is two shards and a batch.
Rounds depend on their input alone: a rerun, or a task that starts again, gives the same vectors.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import step, step_path

#: Nodes of a shard: with 128 numbers, two shards and their sums of squares take 68 MB.
SHARD = 1 << 16
#: Pairs of one gradient step, and pairs that are gone through several times before the next come in.
BATCH, CHUNK = 256, 1 << 16

STATE = "side int, shard int, slot int, vec binary, squares float, frequency double"


def context_pairs(paths: DataFrame, window: int) -> DataFrame:
    """node, context, weight: how often a walk has the context up to ``window`` places before or behind the node. Null paths have none."""
    later = F.flatten(F.transform("path", lambda x, i: F.transform(F.slice("path", i + 2, window), lambda y: F.struct(x.alias("node"), y.alias("context")))))
    once = paths.select(F.explode(later).alias("p")).select("p.*").groupBy("node", "context").agg(F.count(F.lit(1)).alias("n"))
    both = F.array(F.struct("node", "context", "n"), F.struct(F.col("context").alias("node"), F.col("node").alias("context"), "n"))
    return once.select(F.explode(both).alias("p")).groupBy("p.node", "p.context").agg(F.sum("p.n").cast("double").alias("weight"))


def _numbered(nodes: DataFrame, counted: DataFrame, shards: int) -> DataFrame:
    """id, shard, slot, frequency: slots count from 0 within a shard, by id."""
    often = counted.groupBy(F.col("context").alias("id")).agg(F.pow(F.sum("weight"), F.lit(0.75)).alias("frequency"))
    dealt = nodes.join(often, "id", "left").withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    slot = (F.row_number().over(Window.partitionBy("shard").orderBy("id")) - 1).alias("slot")
    return step(dealt.select("id", "shard", slot, F.coalesce("frequency", F.lit(0.0)).alias("frequency")), "skipgram-nodes")


def _by_round(counted: DataFrame, numbered: DataFrame, shards: int) -> str:
    """The folder of pairs (a, i, j, weight), a folder a round below it: shard and slot of the node, slot of the context."""
    left = numbered.select(F.col("id").alias("node"), F.col("shard").alias("a"), F.col("slot").alias("i"))
    right = numbered.select(F.col("id").alias("context"), F.col("shard").alias("b"), F.col("slot").alias("j"))
    met = counted.join(left, "node").join(right, "context").select(F.pmod(F.col("b") - F.col("a"), F.lit(shards)).alias("round"), "a", "i", "j", "weight")
    path = step_path(counted.sparkSession, "skipgram-pairs")
    met.repartition("round", "a").write.partitionBy("round").parquet(path)
    return path


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _move(vectors: np.ndarray, squares: np.ndarray, at: np.ndarray, gradients: np.ndarray, rate: float) -> None:
    """One step of every vector in ``at``, whose gradients are summed, along its sum, scaled by the squares it has had."""
    order = np.argsort(at, kind="stable")
    ids, starts = np.unique(at[order], return_index=True)
    total = np.add.reduceat(gradients[order], starts, axis=0)
    squares[ids] += np.mean(total * total, axis=1)
    vectors[ids] -= rate * total / np.sqrt(squares[ids] + 1e-12)[:, None]


class _Block:
    """Two shards in memory and the pairs between them, which stream by."""

    def __init__(self, block: int, dim: int, passes: int, negative: int, rate: float, seed: list[int]):
        self.block, self.dim, self.passes, self.negative, self.rate = block, dim, passes, negative, rate
        self.rng = np.random.default_rng([*seed, block])
        self.kept: list[list] = [[], []]
        self.sides: list | None = None
        self.waiting: list[np.ndarray] = []
        self.n = 0

    def take(self, kind: np.ndarray, batch: pa.RecordBatch) -> None:
        for side in (0, 1):
            if (kind == side).any():
                self.kept[side].append(batch.filter(pa.array(kind == side)))
        pair = kind == 2
        if pair.any():
            i, j, w = (batch.column(c).to_numpy(zero_copy_only=False)[pair] for c in ("slot", "other", "weight"))
            self.waiting.append(np.stack([i, j, w]).astype(np.float64))
            self.n += len(i)
            if self.n >= CHUNK:
                self._train(False)

    def _open(self) -> None:
        self.sides = []
        for side, parts in enumerate(self.kept):
            t = pa.Table.from_batches(parts) if parts else None
            n = len(t) if t else 0
            given = t.column("vec").to_pylist() if n else []
            if n and given[0] is not None:
                vectors = np.frombuffer(b"".join(given), dtype=np.float32).reshape(n, self.dim).copy()
            elif side == 0:
                vectors = ((self.rng.random((n, self.dim)) - 0.5) / self.dim).astype(np.float32)
            else:
                vectors = np.zeros((n, self.dim), dtype=np.float32)
            squares = t.column("squares").to_numpy().astype(np.float32).copy() if n else np.zeros(0, np.float32)
            self.sides.append((t.drop_columns(["vec"]) if t else None, vectors, squares))
            parts.clear()
        out = self.sides[1][0]
        self.cumulated = np.cumsum(out.column("frequency").to_numpy()) if out else np.zeros(0)

    def _train(self, last: bool) -> None:
        if self.sides is None:
            self._open()
        every = np.concatenate(self.waiting, axis=1) if self.waiting else np.zeros((3, 0))
        end = self.n if last else self.n - self.n % CHUNK
        for lo in range(0, end, CHUNK):
            some = every[:, lo : min(lo + CHUNK, end)]
            for _ in range(self.passes):
                mixed = some[:, self.rng.permutation(some.shape[1])]
                for at in range(0, mixed.shape[1], BATCH):
                    self._step(mixed[:, at : at + BATCH])
        self.waiting, self.n = [every[:, end:]], self.n - end

    def _step(self, some: np.ndarray) -> None:
        (_, vectors, v_squares), (_, contexts, c_squares) = self.sides
        i, j, w = some[0].astype(np.int64), some[1].astype(np.int64), some[2].astype(np.float32)
        other = np.searchsorted(self.cumulated, self.rng.random((len(i), self.negative)) * self.cumulated[-1], side="right").clip(max=len(contexts) - 1)
        own, near, far = vectors[i], contexts[j], contexts[other]
        pull = w * (_sigmoid(np.einsum("nd,nd->n", own, near)) - 1)
        push = np.where(other == j[:, None], 0, w[:, None] * _sigmoid(np.einsum("nd,nkd->nk", own, far)))
        g_own = pull[:, None] * near + np.einsum("nk,nkd->nd", push, far)
        g_context = np.concatenate([pull[:, None] * own, (push[:, :, None] * own[:, None, :]).reshape(-1, self.dim)])
        _move(vectors, v_squares, i, g_own, self.rate)
        _move(contexts, c_squares, np.concatenate([j, other.ravel()]), g_context, self.rate)

    def rows(self) -> Iterator[pa.RecordBatch]:
        self._train(True)
        for side, (t, vectors, squares) in enumerate(self.sides):
            if t is not None:
                vec = pa.array([v.tobytes() for v in vectors], pa.binary())
                columns = [pa.array(np.full(len(t), side, np.int32)), t.column("shard"), t.column("slot"), vec, pa.array(squares), t.column("frequency")]
                yield from pa.table(columns, names=["side", "shard", "slot", "vec", "squares", "frequency"]).to_batches(max_chunksize=8192)


def _trainer(dim: int, passes: int, negative: int, rate: float, seed: list[int]) -> Callable:
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = None
        for batch in batches:
            block, kind = batch.column("block").to_numpy(), batch.column("kind").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(block)) + 1), len(block)]
            for lo, hi in zip(cuts, cuts[1:]):
                if hi > lo:
                    if now is None or now.block != block[lo]:
                        if now is not None:
                            yield from now.rows()
                        now = _Block(int(block[lo]), dim, passes, negative, rate, seed)
                    now.take(kind[lo:hi], batch.slice(lo, hi - lo))
        if now is not None:
            yield from now.rows()

    return train


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        v = [np.frombuffer(x, dtype=np.float32).astype(np.float64) for x in batch.column("vec").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(v, pa.list_(pa.float64()))], ["id", "vector"])


def _first(dim: int, seed: int) -> Callable:
    """The first random vector of an id."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = [(np.random.default_rng([seed, zlib.crc32(str(x).encode())]).random(dim) - 0.5) / dim for x in batch.column("id").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(v, pa.list_(pa.float64()))], ["id", "vector"])

    return work


def skip_gram(
    paths: DataFrame, dim: int = 128, window: int = 10, epochs: int = 2, passes: int = 10, negative: int = 5, rate: float = 0.1, seed: int = 42, shard: int = SHARD
) -> DataFrame:
    """id, vector: a vector for every node on a walk of ``paths`` (column path), whatever its count; nodes without a pair keep their first random one."""
    spark = paths.sparkSession
    counted = step(context_pairs(paths, window), "skipgram-counted")
    every = step(paths.select(F.explode("path").alias("id")).where("id IS NOT NULL").distinct(), "skipgram-ids")
    nodes = step(counted.where("node IS NOT NULL AND context IS NOT NULL").select(F.col("node").alias("id")).distinct(), "skipgram-paired")
    shards = max(1, -(-nodes.count() // shard))
    numbered = _numbered(nodes, counted.where("node IS NOT NULL AND context IS NOT NULL"), shards)
    folder = _by_round(counted, numbered, shards)
    pairs = spark.read.schema("a int, i int, j int, weight double, round int").parquet(folder)
    state = numbered.select(
        F.explode(F.array(F.lit(0), F.lit(1))).alias("side"), "shard", "slot", F.lit(None).cast("binary").alias("vec"), F.lit(0.0).cast("float").alias("squares"), "frequency"
    )
    for epoch in range(epochs):
        for r in range(shards):
            block = F.when(F.col("side") == 0, F.col("shard")).otherwise(F.pmod(F.col("shard") - r, F.lit(shards))).alias("block")
            held = state.select(block, F.col("side").alias("kind"), F.col("slot").cast("long").alias("place"), "shard", "slot", F.lit(0).alias("other"), F.lit(0.0).alias("weight"), "vec", "squares", "frequency")
            place = F.xxhash64(F.lit(seed), F.lit(epoch), "i", "j").alias("place")
            passing = pairs.where(F.col("round") == r).select(
                F.col("a").alias("block"), F.lit(2).alias("kind"), place, F.col("a").alias("shard"), F.col("i").alias("slot"), F.col("j").alias("other"), "weight",
                F.lit(None).cast("binary").alias("vec"), F.lit(0.0).cast("float").alias("squares"), F.lit(0.0).alias("frequency"),
            )
            dealt = held.unionByName(passing).repartition(2 * shards, "block").sortWithinPartitions("block", "kind", "place", "slot", "other")
            state = step(dealt.mapInArrow(_trainer(dim, passes, negative, rate, [seed, epoch, r]), STATE), "skipgram")
    own = state.where("side = 0").join(numbered.select("id", "shard", "slot"), ["shard", "slot"]).select("id", "vec")
    shape = f"id {nodes.schema['id'].dataType.simpleString()}, vector array<double>"
    lone = every.join(nodes, "id", "left_anti")
    return own.mapInArrow(_vectors, shape).unionByName(lone.mapInArrow(_first(dim, seed), shape))
