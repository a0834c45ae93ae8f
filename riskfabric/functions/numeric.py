"""Small numeric column helpers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(col: Column, places: int = 2) -> Column:
    """Round half up through floor; the same IEEE operations everywhere, unlike engine ROUND."""
    scale = float(10**places)
    return F.floor(col * scale + 0.5) / scale


def clamp(col: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), col))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, v: acc + v
    )


def euclidean(a: Column, b: Column, eps: float = 0.0) -> Column:
    parts = F.zip_with(a, b, lambda x, y: F.pow(x.cast("double") - y.cast("double") + eps, F.lit(2.0)))
    return F.sqrt(F.aggregate(parts, F.lit(0.0), lambda acc, v: acc + v))
