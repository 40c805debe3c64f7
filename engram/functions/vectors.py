"""Vector similarity as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 for null, zero or unequal lengths."""
    n = norm(a) * norm(b)
    return F.when(a.isNull() | b.isNull() | (F.size(a) != F.size(b)) | (n == 0), 0.0).otherwise(dot(a, b) / n)
