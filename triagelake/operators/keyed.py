"""Keyed state over change logs, safe for keys that hold a large share of all rows.

`latest_per_key` is an aggregate, so every map task sends at most one row per
key. `running_sum` cuts each key into slices of a sequence or of time: the
slice totals are small, and no task ever sorts more than one slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from triagelake.session import cut_lineage


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key; whole-row overwrite, nulls included."""
    payload = [c for c in df.columns if c not in keys]
    out = df.groupBy(*keys).agg(
        F.max_by(F.struct(*payload), F.struct(*order)).alias("_row"))
    return out.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in payload])


def running_sum(df: DataFrame, keys: list[str], slice_col: str, order: list[Column],
                value: str, out: str, descending: bool = False) -> DataFrame:
    """Inclusive running sum of `value` per key in (slice, order) order.

    The first window runs over one row per (key, slice); the second over the
    rows of one slice.
    """
    by = F.col(slice_col).desc() if descending else F.col(slice_col).asc()
    totals = df.groupBy(*keys, slice_col).agg(F.sum(value).alias("_total"))
    before = Window.partitionBy(*keys).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(*keys, slice_col,
                         F.coalesce(F.sum("_total").over(before), F.lit(0)).alias("_base"))
    inside = (Window.partitionBy(*keys, slice_col).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = df.withColumn("_local", F.sum(value).over(inside))
    return (local.join(base, [*keys, slice_col])
                 .withColumn(out, F.col("_base") + F.col("_local")).drop("_base", "_local"))


def ordinal(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """Row number from 1 per key in a total order, without sorting a key in one task.

    Rows are range-partitioned by key and order and written once (checkpoint), so
    the partition of a row is stable. Numbers inside (key, partition) plus the
    counts of the earlier partitions of the key give the row number.
    """
    ranged = cut_lineage(df.repartitionByRange(*keys, *order).withColumn("_p", F.spark_partition_id()))
    counts = ranged.groupBy(*keys, "_p").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offs = counts.select(*keys, "_p", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = ranged.withColumn("_local", F.row_number().over(
        Window.partitionBy(*keys, "_p").orderBy(*order)))
    return (local.join(offs, [*keys, "_p"]).withColumn(out, (F.col("_off") + F.col("_local")).cast("bigint"))
                 .drop("_p", "_off", "_local"))


def top_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int,
                rank: str = "rank") -> DataFrame:
    """First k rows per key. Spark puts a group limit before the shuffle, so a
    map task sends at most k rows per key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def insert_if_absent(target: DataFrame, incoming: DataFrame, keys: list[str],
                     order: list[str]) -> DataFrame:
    """Target plus the first incoming row of every key the target lacks."""
    payload = [c for c in target.columns if c not in keys]
    first = incoming.groupBy(*keys).agg(
        F.min_by(F.struct(*payload), F.struct(*order)).alias("_row"))
    fresh = first.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in payload])
    fresh = fresh.join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh.select(*target.columns))


def merge_patches(log: DataFrame, keys: list[str], fields: list[str], order: list[str]) -> DataFrame:
    """Patch log folded to one row per key: the last non-null value of each field."""
    seq = F.struct(*order)
    return log.groupBy(*keys).agg(*[
        F.max_by(F.col(f), F.when(F.col(f).isNotNull(), seq)).alias(f) for f in fields])


def replace_children(old: DataFrame, new: DataFrame, parent: str) -> DataFrame:
    """Children of every parent seen in `new` are replaced as a whole."""
    touched = new.select(parent).distinct()
    return old.join(touched, parent, "left_anti").unionByName(new.select(*old.columns))
