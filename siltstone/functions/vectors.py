"""Vector expressions on arrays, inside generated code as far as Spark goes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 if either is empty or null, of another length, or has no length."""
    scale = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    fits = (F.size(a) > 0) & (F.size(a) == F.size(b)) & (scale > 0)
    return F.coalesce(F.when(fits, F.try_divide(dot(a, b), scale)), F.lit(0.0))
