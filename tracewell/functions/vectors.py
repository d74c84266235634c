"""Vector columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def noop_vector(dims: int) -> Column:
    """Zero vector: the embedding of the backend that embeds nothing."""
    return F.array_repeat(F.lit(0.0).cast("float"), dims)


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NULL for a zero vector or for different lengths."""
    similarity = F.try_divide(_dot(a, b), F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b)))
    return F.when(F.size(a) == F.size(b), similarity)
