"""Vector kernels as Column functions, accumulated in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda acc, v: acc + v)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_l2(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))))


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector is empty or has no length."""
    size = norm(a) * norm(b)
    return F.when((F.size(a) > 0) & (F.size(b) > 0) & (size > 0), dot(a, b) / size).otherwise(0.0)


def margin_loss(anchor: Column, positive: Column, negative: Column, margin: float = 0.5) -> Column:
    return F.greatest(F.lit(0.0), F.lit(margin) + l2(anchor, positive) - l2(anchor, negative))
