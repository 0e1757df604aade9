"""Per-concept knowledge: JSON lines to one row a concept."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import TERMS


def load_config(path: str) -> dict:
    """One JSON document, read by the driver."""
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def load_dictionary(spark: SparkSession, path: str, key: str = "concept_code") -> DataFrame:
    """Lines without a key are passed over, values that are no list count as none, malformed lines stop the reading."""
    raw = T.StructType([T.StructField(key, T.StringType()), *[T.StructField(k, T.StringType()) for k in TERMS]])
    lines = spark.read.text(path).where(F.trim("value") != "")
    rows = lines.select(F.from_json("value", raw, {"mode": "FAILFAST"}).alias("r")).select("r.*")
    return merge(rows.select(F.col(key).alias("concept_code"), *[F.from_json(k, "array<string>").alias(k) for k in TERMS]))


def merge(rows: DataFrame, key: str = "concept_code") -> DataFrame:
    """The set union of each list by key, sorted; null keys go.

    Distinct (key, list, value) rows are made before they are gathered, so repeated values of a hot key are combined early.
    """
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.coalesce(F.col(k), F.array()).alias("terms")) for k in TERMS])).alias("x")
    flat = rows.where(F.col(key).isNotNull()).select(key, kinds).select(key, "x.kind", F.explode_outer("x.terms").alias("term")).distinct()
    lists = [F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.col("term")))).alias(k) for k in TERMS]
    return flat.groupBy(key).agg(*lists)


def word_lexicon(spark: SparkSession, words: list[str] | str) -> DataFrame:
    """English words, from a list or a text file of one word a line: the gate of the concept-net source."""
    if isinstance(words, str):
        return spark.read.text(words).select(F.lower(F.trim("value")).alias("word")).where("word != ''").distinct()
    return spark.createDataFrame([(w.lower(),) for w in words], "word string").distinct()
