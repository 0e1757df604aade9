"""Vector functions on array columns, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _double(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(_double(a), _double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(_double(a), F.lit(0.0), lambda s, x: s + x * x))


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector has no length."""
    length = norm(a) * norm(b)
    return F.when(length > 0, dot(a, b) / length)


def combine(a: Column, b: Column, how: str = "concat", alpha: float = 0.5) -> Column:
    """Text and structure vectors as one: joined, or weighted (then of equal length, else null)."""
    if how == "concat":
        return F.concat(_double(a), _double(b))
    if how == "weighted":
        sums = F.zip_with(_double(a), _double(b), lambda x, y: x * F.lit(alpha) + y * F.lit(1 - alpha))
        return F.when(F.size(a) == F.size(b), sums)
    raise ValueError(f"no such combination: {how}")


def external_id(i: Column) -> Column:
    return i.cast("string")
