"""Vector similarities in double arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def usable(a: Column) -> Column:
    return a.isNotNull() & (F.size(a) > 0)


def _pair(a: Column, b: Column) -> Column:
    return usable(a) & usable(b) & (F.size(a) == F.size(b))


def raw_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """0 for null, empty, zero and unlike-sized vectors. Known norms spare their computation."""
    scale = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(_pair(a, b) & (scale > 0), raw_dot(a, b) / scale).otherwise(F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.when(_pair(a, b), raw_dot(a, b)).otherwise(F.lit(0.0))


def l2(a: Column, b: Column) -> Column:
    """Euclidean distance; infinite for unlike vectors."""
    squares = F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when(_pair(a, b), F.sqrt(squares)).otherwise(F.lit(float("inf")))
