"""Vector expressions on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from triagelake.functions.evaluate import let


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def unit(a: Column) -> Column:
    """Unit vector in double precision; null for a zero, empty or null vector.

    The vector and its length are bound once, not evaluated per element."""
    return let(a.cast("array<double>"), lambda d: let(norm(d), lambda n: F.when(
        n > 1e-12, F.transform(d, lambda x: x / n))))
