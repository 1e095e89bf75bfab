"""Keep expensive expressions from being evaluated more than once.

Catalyst inlines projections into filters and copies an expression into every
place that uses it; a chain of regular expressions or a JSON parse is then run
again for each use. A generator is a boundary it does not inline across.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, cols: dict[str, Column], keep: list[str] | None = None) -> DataFrame:
    """df (or its columns `keep`) with `cols` added or replaced, each computed once per row."""
    kept = [c for c in (df.columns if keep is None else keep) if c not in cols]
    row = F.struct(*[c.alias(n) for n, c in cols.items()])
    out = df.select(*kept, F.explode(F.array(row)).alias("_once"))
    return out.select(*kept, *[F.col(f"_once.{n}").alias(n) for n in cols])


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once per row, inside an expression."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))
