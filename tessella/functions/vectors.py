"""Vector functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null for zero vectors."""
    both = norm(a) * norm(b)
    return F.when(both > 0, dot(a, b) / both)


def unit(a: Column) -> Column:
    return F.transform(a, lambda x: x / norm(a))


def quantise(a: Column) -> Column:
    """struct of int8 values and their scale (largest magnitude / 127)."""
    scale = F.array_max(F.transform(a, lambda x: F.abs(x.cast("double")))) / 127
    values = F.transform(a, lambda x: F.when(scale > 0, F.greatest(F.lit(-127), F.least(F.lit(127), F.round(x / scale)))).otherwise(0).cast("tinyint"))
    return F.struct(values.alias("q"), scale.alias("scale"))


def dequantise(q: Column, scale: Column) -> Column:
    return F.transform(q, lambda x: x * scale)
