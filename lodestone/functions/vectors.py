"""Vector functions as columns; all sums are in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(v: Column) -> Column:
    """v over its length; a zero vector stays as it is."""
    return F.element_at(F.transform(F.array(F.struct(doubles(v).alias("v"), norm(v).alias("n"))), lambda s: F.transform(s["v"], lambda x: x / F.when(s["n"] == 0, F.lit(1.0)).otherwise(s["n"]))), 1)


def similarity(distance: Column) -> Column:
    return 1 / (1 + distance)


def int8(v: Column) -> Column:
    """Symmetric quantisation: struct(scale, q array<int>); halves round to even, a zero vector has scale 1."""
    scale = F.array_max(F.transform(doubles(v), F.abs)) / 127
    pair = F.struct(doubles(v).alias("v"), F.when(scale == 0, F.lit(1.0)).otherwise(scale).alias("s"))
    return F.element_at(F.transform(F.array(pair), lambda p: F.struct(p["s"].alias("scale"), F.transform(p["v"], lambda x: F.greatest(F.lit(-127), F.least(F.lit(127), F.rint(x / p["s"]).cast("int")))).alias("q"))), 1)
