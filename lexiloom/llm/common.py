"""Shared pieces of the training-data operators: whole texts, rows in key order, small batches."""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import share_code, shared_dir, table
from ..storage import step as cut

__all__ = ["bucket_of", "by_part", "cut", "fresh", "in_key_order", "key_cuts", "numbered", "numbers", "partitions", "shared_dir", "small_batches", "table", "whole_text"]


def whole_text(name: str = "text") -> Column:
    """The text column with null read as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def key_cuts(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most ``parts`` - 1 ascending cut points that deal the values of ``key`` into ranges of like size.

    The driver gets these few numbers only. An empty table has no cuts.
    """
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(F.col(key).cast("long"), at, 20 * parts).alias("at")).first()["at"]
    return sorted({int(x) for x in found or []})


def numbers(values: list) -> Column:
    """A constant array<bigint> (or array of such), as one literal whatever its length."""
    nested = bool(values) and isinstance(values[0], list)
    return F.from_json(F.lit(json.dumps(values)), "array<array<bigint>>" if nested else "array<bigint>")


def bucket_of(key: str, cuts: list[int]) -> Column:
    """The number of cut points not above the key: ranges in key order. A null key sorts before all: range 0.

    The cuts are looked through in two steps of their square root each.
    """
    if not cuts:
        return F.lit(0)
    step = math.isqrt(len(cuts)) + 1
    groups = [cuts[i : i + step] for i in range(0, len(cuts), step)]
    value = F.col(key).cast("long")
    group = F.size(F.filter(numbers([g[0] for g in groups]), lambda c: c <= value))
    inside = F.size(F.filter(F.get(numbers(groups), group - 1), lambda c: c <= value))
    return F.when(value.isNull() | (group == 0), 0).otherwise((group - 1) * step + inside)


def by_part(values: dict[int, int], part: str = "part") -> Column:
    """The value of a row's part, null where there is none."""
    return F.get(numbers([values.get(p) for p in range(max(values) + 1)]), F.col(part))


def in_key_order(df: DataFrame, key: str, *ties: str, carry: bool = False, keys: DataFrame | None = None) -> DataFrame:
    """``df`` dealt into ranges of ``key``, one partition each in key order, rows sorted inside; adds ``part`` and ``lead``.

    A null key sorts before all. With ``carry``, the row before a partition's first one comes in front of it once more,
    marked by ``lead`` (before the very first: the last row of all). ``keys`` may give the same keys where they are cheaper to
    read. The driver holds two numbers a partition.
    """
    spark = df.sparkSession
    parts = partitions(spark)
    first = F.coalesce(F.col(key).cast("long"), F.lit(-(2**63)))  # one number for null that sorts first
    df, keys = df.withColumn("__key", first), (df if keys is None else keys).select(first.alias("__key"))
    cuts = key_cuts(keys, "__key", parts)
    dealt = df.withColumn("part", bucket_of("__key", cuts))
    lead = F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("lead")))
    if carry:
        tops = {r["part"]: r["top"] for r in keys.groupBy(bucket_of("__key", cuts).alias("part")).agg(F.max("__key").alias("top")).collect()}
        full = sorted(tops)
        if full:
            after = by_part({p: full[(i + 1) % len(full)] for i, p in enumerate(full)}).cast("int")
            again = F.concat(lead, F.array(F.struct(after.alias("part"), F.lit(True).alias("lead"))))
            lead = F.when(F.col("__key") == by_part(tops), again).otherwise(lead)
    if carry:
        dealt = dealt.withColumn("__to", F.explode(lead)).drop("part")
        dealt = dealt.withColumn("part", F.col("__to.part")).withColumn("lead", F.col("__to.lead")).drop("__to")
    else:
        dealt = dealt.withColumn("lead", F.lit(False))
    dealt = dealt.repartitionById(len(cuts) + 1, F.col("part").cast("int"))
    return dealt.sortWithinPartitions(F.desc("lead"), "__key", *ties)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Arrow batches of few rows: whole texts in a batch stay far below a worker's memory."""
    share_code(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def numbered(df: DataFrame) -> tuple[DataFrame, list[str]]:
    """``df`` with its columns named by number, and their own names: no helper column can clash, whatever they are."""
    names = df.columns
    return df.toDF(*[f"__c{i}" for i in range(len(names))]), names


def fresh(name: str, names: list[str]) -> str:
    """``name``, with underscores behind it where ``names`` hold it already (in any case)."""
    known = {n.lower() for n in names}
    while name.lower() in known:
        name += "_"
    return name
