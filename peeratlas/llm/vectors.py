"""Rows of embeddings that can be compared."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vec: Column) -> Column:
    """False for vectors that are null, empty, zero or hold null or non-finite components."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return F.coalesce(~F.exists(vec, bad) & F.exists(vec, lambda x: x != 0), F.lit(False))


def dimensions(vectors: DataFrame, vec_col: str) -> int:
    """The longest vector's; shorter ones count as followed by zeros."""
    return vectors.agg(F.max(F.size(vec_col))).first()[0] or 1


def padded(vec: Column, dims: int) -> Column:
    return F.when(F.size(vec) < dims, F.slice(F.concat(vec, F.array_repeat(F.lit(0.0), dims)), 1, dims)).otherwise(vec)


def dot(a: Column, b: Column) -> Column:
    """The inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
