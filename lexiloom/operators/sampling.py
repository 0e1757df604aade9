"""Samples and pools. Choice is by a hash order, so reruns agree."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SIZES = {"xsmall": 0.2, "small": 0.4, "medium": 0.6, "large": 0.8, "full": 1.0}


def hash_key(columns: list[str], seed: int = 42) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(c) for c in columns])


def split(alignment: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Positives (label '1') and the rest."""
    return alignment.where(F.col("label") == "1"), alignment.where(~F.col("label").eqNullSafe("1"))


def balanced(rows: DataFrame, size: int, order: list[Column], positive: Column) -> DataFrame:
    """Up to ``size`` positives and as many others, the first by ``order``.

    Each kind is an ordered limit, so tasks keep ``size`` rows at most before they meet.
    """
    return rows.where(positive).orderBy(*order).limit(size).unionByName(rows.where(~F.coalesce(positive, F.lit(False))).orderBy(*order).limit(size))


def fraction(rows: DataFrame, size: str | float, order: list[Column]) -> DataFrame:
    """Exactly int(n * f) rows, the first by ``order``, whose first column is a number.

    Quantiles of that number bound a narrow band around the cut: rows below it are taken as they are, and only the band is
    put in order.
    """
    f = SIZES[size] if isinstance(size, str) else size
    if f >= 1:
        return rows
    k = int(rows.count() * f)
    low, high = rows.agg(F.percentile_approx(order[0], [max(0.0, f - 0.0005), min(1.0, f + 0.0005)], 100_000).alias("q")).first()["q"] or (None, None)
    below = 0 if low is None else rows.where(order[0] < low).count()
    if low is None or not below <= k <= rows.where(order[0] <= high).count():
        return rows.orderBy(*order).limit(k)
    return rows.where(order[0] < low).unionByName(rows.where(order[0].between(low, high)).orderBy(*order).limit(k - below))


def demonstrations(predictions: DataFrame, order: list[Column], n: int = 5) -> DataFrame:
    """n earlier predictions by ``order``, of these the right ones."""
    return predictions.orderBy(*order).limit(n).where("pred_relation = true_relation")


def expansion_split(edges: DataFrame, order: list[Column], keep: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Of each parent's children, the first max(1, floor(n * keep)) by ``order`` stay; the others are to be found again."""
    n = F.count(F.lit(1)).over(Window.partitionBy("parent"))
    nth = F.row_number().over(Window.partitionBy("parent").orderBy(*order))
    marked = edges.withColumn("__keep", nth <= F.greatest(F.lit(1), F.floor(n * F.lit(keep))))
    return marked.where("__keep").drop("__keep"), marked.where("not __keep").drop("__keep")


def unseen(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys are not done: resuming, and evaluation pools."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def having(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known.select(key).distinct(), key, "left_semi")


def negatives(src: DataFrame, tgt: DataFrame, seen: DataFrame, order: list[Column] | None = None, size: int | None = None) -> DataFrame:
    """Pairs of a source and a target code that are not aligned: the cross product, asked for where no negatives are given.

    src: s; tgt: t; seen: s, t. The product is the definition. With ``size``, only as many sources and targets enter it as
    are needed: size + seen pairs are sure to leave ``size`` of them, where there are so many.
    """
    if size is not None and order:
        total, n_src, n_tgt = size + seen.count(), src.count(), tgt.count()
        if not n_src or not n_tgt:
            return src.crossJoin(tgt)
        take_tgt = min(n_tgt, math.isqrt(total) + 1)
        take_src = min(n_src, -(-total // take_tgt))
        take_tgt = min(n_tgt, -(-total // take_src))
        src, tgt = (x.orderBy(F.xxhash64(c), c).limit(n) for x, c, n in ((src, "s", take_src), (tgt, "t", take_tgt)))
    pairs = src.crossJoin(tgt).join(seen, ["s", "t"], "left_anti")
    return pairs.orderBy(*order).limit(size) if size is not None and order else pairs
