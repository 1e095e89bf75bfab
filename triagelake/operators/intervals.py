"""Counts and newest rows inside per-row time windows, without pairing rows.

A window join that pairs every incident with every log row in its window grows
with the product of both for a busy entity. Here both sides are ranked on one
time axis: a prefix count at both window ends gives the number of rows inside,
and the newest rows are fetched by their rank.
"""

from __future__ import annotations

from bisect import bisect_left
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triagelake.operators.keyed import running_sum

SLICE_SECONDS = 60
PART_ROWS = 200_000         # points of a (key, block) that one task sweeps
PART_WINDOWS = 10_000       # windows of a (key, block) that one task sweeps
OUT_ROWS = 50_000           # rows a sweep holds before it emits them


def _slice(ts, seconds: int):
    return F.floor(F.unix_micros(ts) / (seconds * 1_000_000)).alias("_slice")


def prefix_counts(points: DataFrame, probes: DataFrame, keys: list[str], probe_cols: list[str],
                  seconds: int = SLICE_SECONDS) -> DataFrame:
    """For each probe row the number of points of its keys up to its instant `at`.

    Points have `ts`; probes have `at` and `inclusive`. Points at exactly `at`
    count when inclusive.
    """
    p = points.select(*keys, _slice(F.col("ts"), seconds), F.unix_micros("ts").alias("_t"),
                      F.lit(1).alias("_role"), F.lit(1).alias("_n"),
                      F.lit(None).cast(probes.select(F.struct(*probe_cols)).schema[0].dataType)
                       .alias("_probe"))
    q = probes.select(*keys, _slice(F.col("at"), seconds), F.unix_micros("at").alias("_t"),
                      F.when(F.col("inclusive"), 2).otherwise(0).alias("_role"),
                      F.lit(0).alias("_n"), F.struct(*probe_cols).alias("_probe"))
    both = p.unionByName(q)
    counted = running_sum(both, keys, "_slice", [F.col("_t"), F.col("_role")], "_n", "n_before")
    return (counted.where(F.col("_role") != 1)
                   .select(*keys, *[F.col(f"_probe.{c}").alias(c) for c in probe_cols], "n_before"))


def window_ends(windows: DataFrame, keys: list[str], id_col: str) -> DataFrame:
    """Two probes per window [lo, hi]: before lo, and up to and including hi."""
    ends = F.explode(F.array(
        F.struct(F.col("lo").alias("at"), F.lit(False).alias("inclusive")),
        F.struct(F.col("hi").alias("at"), F.lit(True).alias("inclusive")))).alias("_end")
    return windows.select(*keys, id_col, ends).select(*keys, id_col, "_end.at", "_end.inclusive")


def _bounds(points, windows, keys, id_col, seconds):
    probes = window_ends(windows, keys, id_col)
    c = prefix_counts(points, probes, keys, [id_col, "inclusive"], seconds)
    return c.groupBy(id_col, *keys).agg(
        F.max(F.when(~F.col("inclusive"), F.col("n_before"))).alias("n_lo"),
        F.max(F.when(F.col("inclusive"), F.col("n_before"))).alias("n_hi"))


def newest_in_window(points: DataFrame, windows: DataFrame, key: str, id_col: str, point_id: str,
                     limit: int, seconds: int = SLICE_SECONDS) -> DataFrame:
    """Up to `limit` newest points of each window (id_col, key, lo, hi), ranked from the newest.

    A point gets its ordinal per key; a window then needs the ordinals
    (max(n_lo, n_hi - limit), n_hi], at most `limit` join rows.
    """
    sliced = points.withColumn("_slice", _slice(F.col("ts"), seconds)).withColumn("_one", F.lit(1))
    ranked = (running_sum(sliced, [key], "_slice", [F.col("ts"), F.col(point_id)], "_one", "_pos")
              .drop("_slice", "_one"))
    b = _bounds(points, windows, [key], id_col, seconds).where(F.col("n_hi") > F.col("n_lo"))
    wanted = b.select(
        id_col, key, "n_hi",
        F.explode(F.sequence(F.greatest(F.col("n_lo"), F.col("n_hi") - limit) + 1,
                             F.col("n_hi"))).alias("_pos"))
    return (wanted.join(ranked, [key, "_pos"])
                  .withColumn("rank", (F.col("n_hi") - F.col("_pos") + 1).cast("int"))
                  .drop("n_hi", "_pos"))


def counts_in_window(points: DataFrame, windows: DataFrame, key: str, items: list[str],
                     id_col: str, bucket_seconds: int, seconds: int = SLICE_SECONDS) -> DataFrame:
    """(id, items, n): rows of each item inside each window; items with none are left out.

    `bucket_seconds` is a coarse bucket used to find the items a window can
    meet at all; it changes the cost, not the result.
    """
    width = bucket_seconds * 1_000_000
    bucket = F.floor(F.unix_micros("ts") / width)
    present = points.select(key, *items, bucket.alias("_b")).distinct()
    reach = windows.select(
        id_col, key, "lo", "hi",
        F.explode(F.sequence(F.floor(F.unix_micros("lo") / width),
                             F.floor(F.unix_micros("hi") / width))).alias("_b"))
    cand = reach.join(present, [key, "_b"]).select(id_col, key, *items, "lo", "hi").distinct()
    b = _bounds(points, cand, [key, *items], id_col, seconds)
    return (b.select(id_col, *items, (F.col("n_hi") - F.col("n_lo")).alias("n"))
             .where(F.col("n") > 0))


class TopCounts:
    """Counts of items with the largest ones at hand.

    Items of equal count share a level. A level keeps its items in a heap, the
    levels are in a heap of their own, and entries that no longer hold are
    dropped when they come up, so that a change costs the logarithm of the
    number of items and the k largest cost k of them, however many there are.
    """

    def __init__(self):
        self.counts: dict[str, int] = {}
        self.levels: dict[int, list[str]] = {}
        self.sizes: dict[int, int] = {}
        self.order: list[int] = []

    def change(self, item: str, n: int) -> None:
        old = self.counts.get(item, 0)
        new = old + n
        if old:
            self.sizes[old] -= 1
            if not self.sizes[old]:
                del self.sizes[old], self.levels[old]
        if not new:
            self.counts.pop(item, None)
            return
        self.counts[item] = new
        if new not in self.levels:
            self.levels[new], self.sizes[new] = [item], 1
            heappush(self.order, -new)
        else:
            heappush(self.levels[new], item)
            self.sizes[new] += 1

    def top(self, k: int) -> list[tuple[str, int]]:
        """The k items of the largest counts, largest first, ties to the smaller item."""
        out: list[tuple[str, int]] = []
        seen: list[int] = []
        while self.order and len(out) < k:
            level = -heappop(self.order)
            if level not in self.levels or seen and seen[-1] == level:
                continue
            seen.append(level)
            heap, found = self.levels[level], []
            while heap and len(out) + len(found) < k:
                item = heappop(heap)
                if self.counts.get(item) == level and (not found or found[-1] != item):
                    found.append(item)
            for item in found:
                heappush(heap, item)
            out += [(item, level) for item in found]
        for level in seen:
            heappush(self.order, -level)
        return out


def _sweep(points: list[tuple[int, str, int]], windows: list[tuple[int, int, object]], k: int):
    """(id, item, n) of each window: both ends of every window length move over the points once."""
    points.sort()
    lengths: dict[int, list] = {}
    for lo, hi, key in windows:
        lengths.setdefault(hi - lo, []).append((lo, hi, key))
    for some in lengths.values():
        some.sort(key=lambda w: w[0])
        counts, first, past = TopCounts(), 0, 0
        for lo, hi, key in some:
            if past < len(points) and not counts.counts:
                # Nothing is inside: points before the window never enter.
                past = first = bisect_left(points, (lo,), past)
            while past < len(points) and points[past][0] <= hi:
                counts.change(points[past][1], points[past][2])
                past += 1
            while first < past and points[first][0] < lo:
                counts.change(points[first][1], -points[first][2])
                first += 1
            for item, n in counts.top(k):
                yield key, item, n


def _sweep_groups(k: int, schema: pa.Schema):
    """Sweeps the groups of a partition one after the other; the rows of a group come side by side."""
    def run(batches):
        group, points, windows = None, [], []
        out: list[tuple] = []
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            for *place, at, hi, n, item, key in zip(*columns, strict=True):
                if place != group:
                    if points and windows:
                        out += _sweep(points, windows, k)
                    group, points, windows = place, [], []
                if hi is None:
                    points.append((at, item, n))
                else:
                    windows.append((at, hi, key))
            if len(out) >= OUT_ROWS:
                yield _rows(out, schema)
                out = []
        if points and windows:
            out += _sweep(points, windows, k)
        if out:
            yield _rows(out, schema)
    return run


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)],
                                      schema=schema)


def top_in_window(points: DataFrame, windows: DataFrame, key: str, item: str, id_col: str, k: int,
                  block_seconds: int = 4 * 3600) -> DataFrame:
    """(id, item, n): the k most frequent items of each window, ties to the smaller item.

    Points meet windows of the same key and time block, side by side in one
    partition that holds many keys; one Python task sweeps them all. A block with
    more than PART_ROWS points or PART_WINDOWS windows is cut into parts: points by
    item, windows by id. A part emits at most k items of each of its windows, and
    the best of all parts are the best of all. Nothing grows with windows times
    distinct items. A part costs one sweep of its points for each length of window,
    of which there are few.
    """
    width = block_seconds * 1_000_000
    blocks = F.sequence(F.floor(F.unix_micros("lo") / width), F.floor(F.unix_micros("hi") / width))
    none = F.lit(None).cast("bigint")
    w = windows.where(F.col("hi") >= F.col("lo")).select(
        F.col(key).alias("_key"), F.floor(F.unix_micros("hi") / width).alias("_block"), F.unix_micros("lo").alias("_at"),
        F.unix_micros("hi").alias("_hi"), none.alias("_n"), F.lit(None).cast("string").alias("_item"),
        F.col(id_col).alias("_id"), blocks.alias("_reach"))
    # Which blocks of windows a block of points serves: a few rows for each key.
    reach = w.select("_key", "_block", F.explode("_reach").alias("_from")).distinct()
    p = points.where(F.col(item).isNotNull()).groupBy(
        F.col(key).alias("_key"), F.unix_micros("ts").alias("_at"), F.col(item).alias("_item")) \
        .agg(F.count("*").alias("_n")).withColumn("_from", F.floor(F.col("_at") / width)) \
        .join(reach, ["_key", "_from"])
    p = p.select("_key", "_block", "_at", none.alias("_hi"), "_n", "_item",
                 F.lit(None).cast(windows.schema[id_col].dataType).alias("_id"))
    both = p.unionByName(w.drop("_reach"))
    # Only blocks over the limits have a row here.
    large = both.groupBy("_key", "_block").agg(
        F.ceil(F.count("_n") / PART_ROWS).alias("_parts"), F.ceil(F.count("_hi") / PART_WINDOWS).alias("_shares")) \
        .where("_parts > 1 or _shares > 1")
    cut = both.join(large, ["_key", "_block"], "left").withColumns(
        {c: F.greatest(F.coalesce(c, F.lit(1)), F.lit(1)) for c in ("_parts", "_shares")})
    point = F.col("_hi").isNull()
    every = [F.sequence(F.lit(0).cast("bigint"), F.col(c) - 1) for c in ("_parts", "_shares")]
    own = [F.array(F.pmod(F.xxhash64(i), F.col(c))) for i, c in (("_item", "_parts"), ("_id", "_shares"))]
    dealt = cut.withColumn("_part", F.explode(F.when(point, own[0]).otherwise(every[0]))) \
        .withColumn("_share", F.explode(F.when(point, every[1]).otherwise(own[1])))
    place = ["_key", "_block", "_part", "_share"]
    columns = [*place, "_at", "_hi", "_n", "_item", "_id"]
    kind = dict(windows.dtypes)[id_col]
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]
    schema = pa.schema([(id_col, arrow), (item, pa.string()), ("n", pa.int64())])
    local = dealt.select(*columns).repartition(*place).sortWithinPartitions(*place).mapInArrow(
        _sweep_groups(k, schema), f"{id_col} {kind}, {item} string, n bigint")
    best = F.row_number().over(Window.partitionBy(id_col).orderBy(F.desc("n"), item))
    return local.withColumn("_r", best).where(F.col("_r") <= k).drop("_r")
