"""Dedup with a time to live over keys of any size.

The instants are sorted by (key, instant) into range partitions, so that a key with
a third of all rows covers many partitions and no task holds more than its own. A
*segment* is a run of a key's instants with gaps shorter than the TTL; its first
instant is accepted, whatever came before. A task therefore decides every segment
that begins in its partition alone. Where a segment goes on from the partition
before, what is accepted depends on the last instant accepted there: the task gives
the last accepted instant for each instant that may come first. Those few rows are
linked from partition to partition and followed by pointer doubling, as many times
as the logarithm of the longest run of partitions that one segment covers. What a
second pass over the partitions needs to know is one instant for each partition.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triagelake.session import cut_lineage

Batches = Iterator[pa.RecordBatch]
LINK = "part int, at bigint, to_part int, probe bigint"


def _starts(batches: Batches, key: str, ttl: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Batches of one partition with their instants and, for each row, whether a segment starts there."""
    last_key = last_t = None
    for b in batches:
        if not b.num_rows:
            continue
        keys, t = b.column(key), b.column("_t").to_numpy()
        first = np.ones(len(t), bool)
        first[1:] = (pc.not_equal(keys[1:], keys[:-1]).to_numpy(zero_copy_only=False)
                     | (t[1:] - t[:-1] >= ttl))
        first[0] = last_t is None or keys[0] != last_key or int(t[0]) - last_t >= ttl
        last_key, last_t = keys[-1], int(t[-1])
        yield b, t, first


def _exits(t: np.ndarray, ttl: int) -> tuple[np.ndarray, np.ndarray]:
    """The instants that may be accepted first in a continued segment, and the last one accepted after each."""
    after = np.searchsorted(t, t + ttl)
    entries = np.arange(min(len(t), after[0] + 1))      # what was accepted before lies before t[0]
    at = entries.copy()
    while (more := after[at] < len(t)).any():
        at[more] = after[at[more]]
    return t[entries], t[at]


class _Chunks:
    """What the driver knows of the range partitions: one row for each, never of the data."""

    def __init__(self, points: DataFrame, key: str, ttl: int):
        ends = F.struct(F.col(key).alias("k"), F.col("_t").alias("t"))
        rows = points.groupBy("_part").agg(F.min(ends).alias("lo"), F.max(ends).alias("hi")).orderBy("_part").collect()
        self.parts = [r["_part"] for r in rows]
        n = len(rows)
        #: Whether a partition goes on with the segment its predecessor ends with.
        self.open = [i > 0 and rows[i - 1]["hi"]["k"] == rows[i]["lo"]["k"]
                     and rows[i]["lo"]["t"] - rows[i - 1]["hi"]["t"] < ttl for i in range(n)]
        #: The last instant a probe of that key may find there; none lies behind the end of the key.
        goes_on = [i + 1 < n and self.open[i + 1] and rows[i]["lo"]["k"] == rows[i]["hi"]["k"] for i in range(n)]
        self.reach = np.array([rows[i]["hi"]["t"] if goes_on[i] else np.iinfo(np.int64).max for i in range(n)], np.int64)
        #: Behind the partitions that a segment ending in i can cover.
        self.until, self.longest, end = [0] * n, 0, n
        for i in reversed(range(n)):
            end = i + 1 if not (i + 1 < n and self.open[i + 1]) else end if goes_on[i + 1] else i + 2
            self.until[i] = end
            self.longest = max(self.longest, end - i - 1)
        self.row = {p: i for i, p in enumerate(self.parts)}


def accepted(events: DataFrame, key: str, ts: str, id_col: str, ttl_seconds: int) -> DataFrame:
    """(key, id, instant) of the first event of each key, then of the first at least TTL after the last accepted one.

    Equal instants of a key count as one, with the smallest id. Rows without a key or an
    instant are not accepted.
    """
    ttl = ttl_seconds * 1_000_000
    first = (events.select(key, F.unix_micros(F.col(ts).cast("timestamp")).alias("_t"), id_col)
             .where(F.col(key).isNotNull() & F.col("_t").isNotNull())
             .groupBy(key, "_t").agg(F.min(id_col).alias(id_col)))
    points = cut_lineage(first.repartitionByRange(key, "_t").sortWithinPartitions(key, "_t")
                         .withColumn("_part", F.spark_partition_id()))
    chunks = _Chunks(points, key, ttl)
    begin = _entry_points(points, key, ttl, chunks) if chunks.longest else {}
    open_parts = {p for p, o in zip(chunks.parts, chunks.open, strict=True) if o}

    def sweep(batches: Batches) -> Batches:
        due = None                          # the earliest instant that is accepted next
        for n, (b, t, starts) in enumerate(_starts(batches, key, ttl)):
            if n == 0 and (part := b.column("_part")[0].as_py()) in open_parts:
                starts[0], due = False, begin.get(part, math.inf)
            keep = np.zeros(len(t), bool)
            for i, (now, fresh) in enumerate(zip(t.tolist(), starts.tolist(), strict=True)):
                if fresh or now >= due:
                    keep[i], due = True, now + ttl
            yield b.filter(pa.array(keep)).select([key, "_t", id_col])

    kinds = points.select(key, "_t", id_col).schema
    return points.mapInArrow(sweep, kinds).select(key, id_col, F.timestamp_micros("_t").alias(ts))


def _entry_points(points: DataFrame, key: str, ttl: int, chunks: _Chunks) -> dict[int, int]:
    """The first instant accepted in each partition that goes on with a segment (absent: none in that segment)."""
    row, parts, open_, reach, until = chunks.row, np.array(chunks.parts), chunks.open, chunks.reach, chunks.until

    def link(batches: Batches) -> Batches:
        at = None                           # the row of this partition
        held: list[np.ndarray] = []         # the segment being read
        whole = True                        # whether that segment came from the partition before

        def rows(last: bool) -> Batches:
            t = np.concatenate(held)
            onward = last and until[at] > at + 1
            if whole and open_[at]:
                entries, ends = _exits(t, ttl)
                names = pa.array(entries)
            elif onward:
                ends = t[:1]
                while (i := int(np.searchsorted(t, ends[0] + ttl))) < len(t):
                    ends = t[i:i + 1]
                names = pa.nulls(1, pa.int64())
            else:
                return
            here = pa.array(np.full(len(ends), parts[at], np.int32))
            if onward:
                to = at + 1 + np.searchsorted(reach[at + 1:until[at]], ends + ttl)
                inside = to < until[at]
                to_part = pa.array(parts[np.minimum(to, until[at] - 1)].astype(np.int32), mask=~inside)
                probe = pa.array(ends + ttl, mask=~inside)
            else:
                to_part, probe = pa.nulls(len(ends), pa.int32()), pa.nulls(len(ends), pa.int64())
            yield pa.RecordBatch.from_arrays([here, names, to_part, probe], ["part", "at", "to_part", "probe"])

        for b, t, starts in _starts(batches, key, ttl):
            if at is None:
                at = row[b.column("_part")[0].as_py()]
                if not open_[at] and until[at] == at + 1:
                    return
            cuts = np.flatnonzero(starts)
            for a, z in zip([0, *cuts], [*cuts, len(t)], strict=True):
                if a < z and a in cuts and held:
                    yield from rows(False)
                    held, whole = [], False
                if a < z:
                    held.append(t[a:z])
        if held:
            yield from rows(True)

    links = cut_lineage(points.mapInArrow(link, LINK))
    # The first instant at or behind each probe in the partition it points to.
    target = links.where("at IS NOT NULL").select(
        F.col("part").alias("to_part"), F.col("at").alias("probe"), F.lit(0).alias("role"), F.col("at").alias("to_at"),
        F.lit(None).cast("int").alias("part"), F.lit(None).cast("bigint").alias("at"))
    asking = links.where("probe IS NOT NULL").select(
        "to_part", "probe", F.lit(1).alias("role"), F.lit(None).cast("bigint").alias("to_at"), "part", "at")
    behind = Window.partitionBy("to_part").orderBy(F.desc("probe"), "role").rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    jump = (target.unionByName(asking).withColumn("to_at", F.last("to_at", ignorenulls=True).over(behind))
            .where("role = 1 AND to_at IS NOT NULL").select("part", "at", "to_part", "to_at"))
    jump = cut_lineage(jump)
    reached = jump.where("at IS NULL").select(F.col("to_part").alias("part"), F.col("to_at").alias("at"))
    jump = jump.where("at IS NOT NULL")
    for _ in range(math.ceil(math.log2(chunks.longest))):
        step = reached.join(jump, ["part", "at"]).select(F.col("to_part").alias("part"), F.col("to_at").alias("at"))
        reached = cut_lineage(reached.unionByName(step).distinct())
        onward = jump.select(F.col("part").alias("to_part"), F.col("at").alias("to_at"),
                             F.col("to_part").alias("part2"), F.col("to_at").alias("at2"))
        jump = cut_lineage(jump.join(onward, ["to_part", "to_at"])
                           .select("part", "at", F.col("part2").alias("to_part"), F.col("at2").alias("to_at")))
    # At most one row for each partition.
    return {r["part"]: r["at"] for r in reached.collect()}
