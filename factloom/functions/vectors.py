"""Vector and ratio functions on columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column | str, b: Column | str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column | str) -> Column:
    """The vector over its Euclidean norm; a zero vector stays."""
    n = norm(v)
    return F.transform(v, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def cosine(a: Column | str, b: Column | str) -> Column:
    return ratio(dot(a, b), norm(a) * norm(b))


def ratio(part: Column, whole: Column) -> Column:
    """Part over whole, 0.0 if the whole is 0."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def mean_pool(vectors: Column | str, mask: Column | str) -> Column:
    """Mean of the token vectors whose mask is 1."""
    kept = F.transform(F.filter(F.arrays_zip(F.col(vectors).alias("v") if isinstance(vectors, str) else vectors.alias("v"), F.col(mask).alias("m") if isinstance(mask, str) else mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["v"])
    total = F.aggregate(kept, F.transform(F.element_at(vectors, 1), lambda _: F.lit(0.0)), lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    return F.transform(total, lambda x: ratio(x, F.size(kept)))
