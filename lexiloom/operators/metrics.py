"""Scores and costs of a run."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import PRICE


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _scores(tp: Column, fp: Column, fn: Column) -> list[Column]:
    return [_ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1")]


def _counts(true: str, pred: str, positive) -> dict[str, Column]:
    t, p = F.col(true) == F.lit(positive), F.col(pred) == F.lit(positive)
    return {"tp": F.when(t & p, 1).otherwise(0), "fp": F.when(~t & p, 1).otherwise(0), "fn": F.when(t & ~p, 1).otherwise(0)}


def score(rows: DataFrame, true: str = "true_relation", pred: str = "pred_relation", positive=1) -> DataFrame:
    """Precision, recall and F1 in one pass; 0 where a denominator is 0."""
    sums = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in _counts(true, pred, positive).items()])
    return sums.select(*_scores(F.col("tp"), F.col("fp"), F.col("fn")))


def _part(key: Column, cuts: list) -> Column:
    """The number of cuts not above the key, looked up in two steps of the square root of their number each."""
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    group = F.size(F.filter(F.lit([g[0] for g in groups]), lambda c: c <= key))
    inside = F.size(F.filter(F.get(F.array(*[F.lit(g) for g in groups]), group - 1), lambda c: c <= key))
    return F.when(group == 0, 0).otherwise((group - 1) * step + inside)


def running_score(rows: DataFrame, order: str, true: str = "true_relation", pred: str = "pred_relation", positive=1, buckets: int = 0) -> DataFrame:
    """Before every row, the scores over all rows ahead of it in ``order`` (a total order of numbers).

    Ranges of like size (by quantiles) are summed first, so no task holds all rows: a row's counts are those of the ranges
    ahead (a row a range) and those ahead of it in its own range, by whose partitioning both are joined.
    """
    n = rows.count()
    buckets = buckets or max(1, -(-n // 100_000))
    cuts = rows.agg(F.percentile_approx(order, [i / buckets for i in range(1, buckets)], 20 * buckets).alias("at")).first()["at"] if buckets > 1 else None
    counted = rows.withColumn("__part", _part(F.col(order), sorted(set(cuts or []))))
    counted = counted.withColumns({f"__{k}": c for k, c in _counts(true, pred, positive).items()})
    keys = [f"__{k}" for k in ("tp", "fp", "fn")]
    ahead = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = counted.groupBy("__part").agg(*[F.sum(k).alias(k) for k in keys])
    sums = sums.select("__part", *[F.coalesce(F.sum(k).over(ahead), F.lit(0)).alias(f"{k}_ahead") for k in keys])
    inside = Window.partitionBy("__part").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    both = counted.withColumns({f"{k}_in": F.coalesce(F.sum(k).over(inside), F.lit(0)) for k in keys}).join(sums, "__part")
    totals = [F.col(f"{k}_in") + F.col(f"{k}_ahead") for k in keys]
    return both.select(*rows.columns, *_scores(*totals))


def usage(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Token and call totals of rows with input_token, output_token, api_calls."""
    sums = [F.coalesce(F.sum(k), F.lit(0)).alias(k) for k in ("input_token", "output_token", "api_calls")]
    return rows.groupBy(*(by or [])).agg(*sums)


def cost(rows: DataFrame, prices: DataFrame, by: list[str], order: str | None = None) -> DataFrame:
    """Total cost by group, an unknown model at price 0; with ``order``, the last call's cost as well.

    Prices are in USD for a million tokens; one row a model.
    """
    priced = rows.join(prices, ["backend", "model"], "left")
    one = (F.col("input_token") * F.coalesce("usd_in", F.lit(0.0)) + F.col("output_token") * F.coalesce("usd_out", F.lit(0.0))) / 1e6
    priced = priced.withColumn("cost", one)
    out = [F.sum("cost").alias("total_cost"), F.sum("input_token").alias("input_token"), F.sum("output_token").alias("output_token"), F.count(F.lit(1)).alias("api_calls")]
    if order:
        out.append(F.max_by("cost", order).alias("last_cost"))
    return priced.groupBy(*by).agg(*out)


#: USD for a million tokens, input and output, by backend and model.
PRICES = [
    ("huggingface", "google/flan-t5-xxl", 0.0, 0.0),
    ("huggingface", "meta-llama/Llama-2-7b-hf", 0.0, 0.0),
    ("huggingface", "mosaicml/mpt-7b", 0.0, 0.0),
    ("togetherai", "google/gemma-2b-it", 0.1, 0.1),
    ("togetherai", "meta-llama/Llama-3.2-3B-Instruct-Turbo", 0.06, 0.06),
    ("togetherai", "mistralai/Mistral-7B-Instruct-v0.3", 0.2, 0.2),
    ("togetherai", "meta-llama-llama-2-70b-hf", 0.9, 0.9),
    ("togetherai", "meta-llama/Meta-Llama-3.1-70B-Instruct-Turbo", 0.88, 0.88),
    ("togetherai", "meta-llama/Llama-3.3-70B-Instruct-Turbo", 0.88, 0.88),
    ("togetherai", "meta-llama/Llama-3.3-70B-Instruct-Turbo-Free", 0.0, 0.0),
    ("togetherai", "Qwen/Qwen2.5-7B-Instruct-Turbo", 0.3, 0.3),
    ("togetherai", "deepseek-ai/DeepSeek-R1-Distill-Qwen-1.5B", 0.18, 0.18),
    ("togetherai", "deepseek-ai/DeepSeek-R1-Distill-Llama-70B-free", 0.0, 0.0),
    ("openai", "chatgpt-4o-latest", 5.0, 15.0),
    ("openai", "o3-mini", 1.10, 4.40),
    ("openai", "o1-mini", 1.10, 4.40),
    ("openai", "gpt-4o", 2.5, 10.0),
    ("openai", "gpt-4o-mini", 0.15, 0.6),
    ("openai", "gpt-3.5-turbo-0125", 0.5, 1.5),
]


def price_table(spark) -> DataFrame:
    return spark.createDataFrame(PRICES, PRICE)
