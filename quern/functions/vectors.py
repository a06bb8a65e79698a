"""Vector arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 for empty vectors or ones of different lengths; a zero norm counts as 1."""
    norm = lambda v: F.when(dot(v, v) == 0, 1.0).otherwise(F.sqrt(dot(v, v)))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), dot(a, b) / (norm(a) * norm(b))).otherwise(0.0)
