"""Vector arithmetic as columns, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _products(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """The inner product; 0 for empty vectors or different lengths."""
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), _products(a, b)).otherwise(F.lit(0.0))


def norm(a: Column) -> Column:
    return F.sqrt(_products(a, a))


def cosine(a: Column, b: Column) -> Column:
    """The cosine; 0 for empty vectors, different lengths or a zero norm."""
    lengths = norm(a) * norm(b)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0) & (lengths > 0), _products(a, b) / lengths).otherwise(F.lit(0.0))


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = norm(a)
    return F.when(n > 0, F.transform(a, lambda x: x.cast("double") / n)).otherwise(F.transform(a, lambda x: x.cast("double")))
