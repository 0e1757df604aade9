"""Embedders (pluggable), structural embeddings from random walks, and their combination."""

from __future__ import annotations

import zlib
from abc import ABC, abstractmethod
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import combine
from ..storage import step
from .skipgram import skip_gram


class Embedder(ABC):
    """Texts to vectors of ``dim`` numbers. Instances go to the workers, so they pickle."""

    dim: int

    @abstractmethod
    def encode(self, texts: list[str]) -> np.ndarray: ...

    def column(self, text: Column) -> Column:
        own = self

        @F.pandas_udf("array<float>")
        def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for s in batches:
                yield pd.Series(list(own.encode(s.fillna("").tolist()).astype(np.float32)))

        return embed(text)


class HashEmbedder(Embedder):
    """Character trigrams hashed into a unit vector: an offline stand-in, no language model."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            t = f"  {t.lower()} "
            for k in range(len(t) - 2):
                h = zlib.crc32(t[k : k + 3].encode("utf-8", "replace"))
                out[i, h % self.dim] += 1 if h >> 31 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(n > 0, n, 1)


class TransformerEmbedder(Embedder):
    """A pretrained encoder, where its libraries are installed: the first token's vector, or the mean over all tokens."""

    def __init__(self, model: str, pooling: str = "first", max_tokens: int = 512, batch: int = 64):
        self.model, self.pooling, self.max_tokens, self.batch = model, pooling, max_tokens, batch

    @property
    def dim(self) -> int:
        return self._load()[1].config.hidden_size

    def _load(self):
        if not hasattr(self, "_own"):
            try:
                from transformers import AutoModel, AutoTokenizer
            except ImportError as e:
                raise ImportError("this embedder needs torch and transformers") from e
            self._own = (AutoTokenizer.from_pretrained(self.model), AutoModel.from_pretrained(self.model).eval())
        return self._own

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_own"}

    def encode(self, texts: list[str]) -> np.ndarray:
        tokenizer, model = self._load()
        import torch

        out = []
        for i in range(0, len(texts), self.batch):
            some = tokenizer(texts[i : i + self.batch], padding=True, truncation=True, max_length=self.max_tokens, return_tensors="pt")
            with torch.no_grad():
                states = model(**some).last_hidden_state
            mask = some["attention_mask"].unsqueeze(-1)
            out.append((states[:, 0, :] if self.pooling == "first" else (states * mask).sum(1) / mask.sum(1).clamp(min=1)).numpy())
        return np.concatenate(out) if out else np.zeros((0, 0))


EMBEDDERS: dict[str, Callable[..., Embedder]] = {
    "hash": HashEmbedder,
    "huggingface": lambda model, **o: TransformerEmbedder(model, "first", **o),
    "sentence-transformers": lambda model, **o: TransformerEmbedder(model, "mean", **o),
}


def create_embedder(backend: str = "hash", **options) -> Embedder:
    if backend not in EMBEDDERS:
        raise ValueError(f"unknown embedding backend: {backend}")
    return EMBEDDERS[backend](**options)


#: Parts in which the neighbours of a node are numbered side by side.
PARTS = 64


def _numbered(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Neighbours as rows (at, nth from 0, next, next_degree), and degrees (at, degree): a hub is many rows, never an array.

    The neighbours of a node are numbered in parts by hash, each behind the parts before it, so that no task orders a hub's whole list.
    """
    e = step(edges.where("parent IS NOT NULL AND child IS NOT NULL").select(F.col("parent").alias("at"), F.col("child").alias("next")).distinct(), "edges")
    e = e.withColumn("part", F.pmod(F.xxhash64("next"), F.lit(PARTS)))
    counts = e.groupBy("at", "part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("at").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("offset", F.coalesce(before, F.lit(0)))
    degrees = step(counts.groupBy("at").agg(F.sum("n").alias("degree")), "degrees")
    own = F.row_number().over(Window.partitionBy("at", "part").orderBy("next")) - 1
    rows = e.withColumn("own", own).join(offsets, ["at", "part"]).select("at", (F.col("own") + F.col("offset")).alias("nth"), "next")
    rows = rows.join(degrees.withColumnsRenamed({"at": "next", "degree": "next_degree"}), "next", "left")
    return step(rows.select("at", "nth", "next", F.coalesce("next_degree", F.lit(0)).alias("next_degree")), "near"), degrees


def walks(nodes: DataFrame, edges: DataFrame, length: int = 30, per_node: int = 200, p: float = 1.0, q: float = 1.0, seed: int = 42) -> DataFrame:
    """walk_id, path: random walks along edges, ``per_node`` from each node.

    A step picks the number of a neighbour by hash, so a rerun walks the same ways, and joins on node and number: many walks at
    one hub meet its many rows. With p or q other than 1 see ``_biased``. Walks that have come to an end are written
    apart every few steps.
    """
    near, degrees = _numbered(edges)
    now = nodes.select("id").join(degrees.withColumnRenamed("at", "id"), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"), F.explode(F.sequence(F.lit(1), F.lit(per_node))).alias("n"))
    now = now.select(F.concat_ws("#", "id", "n").alias("walk_id"), F.array("id").alias("path"), F.col("id").alias("at"), "degree")
    if p != 1 or q != 1:
        return _biased(now, near, length, p, q, seed)
    ended = None
    for i in range(1, length):
        both = now.withColumn("nth", F.floor(_roll(seed, i) * F.col("degree"))).join(near, ["at", "nth"], "left")
        now = both.select(
            "walk_id", F.when(F.col("next").isNotNull(), F.concat("path", F.array("next"))).otherwise(F.col("path")).alias("path"),
            F.col("next").alias("at"), F.coalesce("next_degree", F.lit(0)).alias("degree"),
        )
        if i % 5 == 0:
            every = step(now, "walks")
            over, now = every.where("at IS NULL").select("walk_id", "path"), every.where("at IS NOT NULL")
            ended = over if ended is None else ended.unionByName(over)
            if now.isEmpty():
                break
    rest = now.select("walk_id", "path")
    return rest if ended is None else ended.unionByName(rest)


def _roll(seed: int, *what: int) -> Column:
    """A number from 0 to under 1 by hash of the walk."""
    return F.pmod(F.xxhash64(F.lit(seed), *[F.lit(w) for w in what], "walk_id"), F.lit(1 << 30)).cast("double") / (1 << 30)


def _biased(now: DataFrame, near: DataFrame, length: int, p: float, q: float, seed: int) -> DataFrame:
    """Walks on which a step back weighs 1/p, one to a neighbour of the place before 1, any other 1/q.

    Exact by rejection, without a list of neighbours: a walk proposes one neighbour by number, looks up by a join whether an edge
    leads there from the place before, and takes it with its weight's share of the greatest weight; a walk whose proposal was
    refused proposes again in the next round. A return that weighs more than all others has a share of its own of the proposals,
    so a small p costs no refusals; where there is one neighbour only it is taken.
    """
    if p <= 0 or q <= 0:
        raise ValueError("p and q must be above 0")
    most = max(1.0, 1.0 / q)
    extra = max(0.0, 1.0 / p - most)
    known = near.select(F.col("at").alias("before"), "next", F.lit(True).alias("linked"))
    back = near.select(F.col("next").alias("at"), F.col("at").alias("next"), F.lit(True).alias("returns"))
    near = step(near.join(back, ["at", "next"], "left").withColumn("returns", F.coalesce("returns", F.lit(False))), "near")
    # ``returns``: an edge leads back to the place before, which has ``before_degree`` neighbours
    now = now.select("walk_id", "path", "at", "degree", F.lit(None).cast(now.schema["at"].dataType).alias("before"), F.lit(0).cast("long").alias("before_degree"), F.lit(False).alias("returns"))
    ended, i = None, 0
    while length > 1:
        i += 1
        own = F.col("at").isNotNull() & F.col("returns") & (_roll(seed, i, 1) * (extra + F.col("degree") * most) < extra)
        tried = now.withColumn("own", own).withColumn("nth", F.floor(_roll(seed, i, 0) * F.col("degree")))
        tried = tried.join(near.withColumnRenamed("returns", "next_returns"), ["at", "nth"], "left").join(known, ["before", "next"], "left")
        weight = F.when(F.col("before").isNull(), most).when(F.col("next") == F.col("before"), min(1.0 / p, most)).when(F.col("linked"), 1.0).otherwise(1.0 / q)
        taken = (F.col("degree") == 1) | (_roll(seed, i, 2) * most < weight)
        goes = F.when(F.col("own"), F.col("before")).when(taken, F.col("next"))
        moved = tried.withColumn("to", goes).withColumn("stuck", F.col("degree") == 0)
        go = F.col("to").isNotNull()
        now = moved.select(
            "walk_id", F.when(go, F.concat("path", F.array("to"))).otherwise(F.col("path")).alias("path"),
            F.when(F.col("stuck"), F.lit(None)).when(go, F.col("to")).otherwise(F.col("at")).alias("at"),
            F.when(F.col("own"), F.col("before_degree")).when(go, F.col("next_degree")).otherwise(F.col("degree")).alias("degree"),
            F.when(go, F.col("at")).otherwise(F.col("before")).alias("before"),
            F.when(go, F.col("degree")).otherwise(F.col("before_degree")).alias("before_degree"),
            F.when(F.col("own"), F.lit(True)).when(go, F.col("next_returns")).otherwise(F.col("returns")).alias("returns"),
        )
        # a walk of full length waits, so that no path grows beyond it
        now = now.withColumn("at", F.when(F.size("path") < length, F.col("at"))).withColumn("degree", F.when(F.col("at").isNull(), 0).otherwise(F.col("degree")))
        if i % 4 == 0:
            every = step(now, "walks")
            over, now = every.where("at IS NULL").select("walk_id", "path"), every.where("at IS NOT NULL")
            ended = over if ended is None else ended.unionByName(over)
            if now.isEmpty():
                break
    rest = now.select("walk_id", "path")
    return rest if ended is None else ended.unionByName(rest)


def structural(nodes: DataFrame, edges: DataFrame, dim: int = 128, length: int = 30, per_node: int = 200, window: int = 10, seed: int = 42, p: float = 1.0, q: float = 1.0) -> DataFrame:
    """id, structure: skip-gram vectors of the nodes on walks; zeros for nodes no walk holds. Trained once for all sides."""
    zeros = F.array_repeat(F.lit(0.0), dim)
    if edges.isEmpty():
        return nodes.select("id", zeros.alias("structure"))
    starts = nodes.select("id").join(edges.where("parent IS NOT NULL AND child IS NOT NULL").select(F.col("parent").alias("id")).distinct(), "id")
    paths = walks(starts, edges, length, per_node, p, q, seed)
    # from a node without neighbours all walks are the node itself: one says as much as all
    still = nodes.select("id").join(starts.select("id"), "id", "left_anti").select(F.col("id").alias("walk_id"), F.array("id").alias("path"))
    paths = step(paths.unionByName(still), "paths")
    vectors = skip_gram(paths, dim, window, seed=seed).withColumnRenamed("vector", "structure")
    return nodes.select("id").distinct().join(vectors, "id", "left").withColumn("structure", F.coalesce("structure", zeros))


def combined(labelled: DataFrame, structure: DataFrame, embedder: Embedder, how: str = "concat", alpha: float = 0.5) -> DataFrame:
    """id, embedding: text vectors of (id, text) with the nodes' structure vectors."""
    both = labelled.withColumn("__v", embedder.column(F.col("text"))).join(structure, "id", "left")
    return both.select("id", combine(F.col("__v"), F.col("structure"), how, alpha).alias("embedding"))
