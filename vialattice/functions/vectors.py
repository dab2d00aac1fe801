"""Vector arithmetic on ``array<double>`` columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v * v))


def normalize(a: Column, floor: float = 1e-8) -> Column:
    """Divided by the length, which counts as ``floor`` at least."""
    return F.transform(F.array(F.struct(a.alias("v"), F.greatest(norm(a), F.lit(floor)).alias("n"))), lambda z: F.transform(z["v"], lambda x: x / z["n"]))[0]


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(a, b) / ((norm(a) + eps) * (norm(b) + eps))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def sinusoidal(t: Column, dim: int) -> Column:
    """Cosine and sine embedding of a step."""
    half = dim // 2
    freqs = F.transform(F.sequence(F.lit(0), F.lit(half - 1)), lambda k: t * F.exp(-F.log(F.lit(10000.0)) * k / F.lit(float(half))))
    return F.concat(F.transform(freqs, lambda a: F.cos(a)), F.transform(freqs, lambda a: F.sin(a)))
