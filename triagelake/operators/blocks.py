"""Exact nearest-vector search by pruned blocks.

Every vector belongs to the cell of its nearest pivot (a fixed number of
pivots). A probe visits only the cells its search angle can reach by the
triangle inequality on angles, so nothing is lost. A cell of more than BLOCK
vectors is cut into parts and probes into parts alike; one task takes one pair
of parts, multiplies it with numpy a block at a time and emits only the best
rows. No task holds more than one pair of parts, whatever share of the rows a
cell holds. A vector travels once for every part of the other side, so parts
are few (FEW) as long as they fit a task (TILE_NUMBERS).
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions.evaluate import once
from triagelake.functions.rules import lookup
from triagelake.functions.vectors import unit
from triagelake.operators.keyed import top_per_key
from triagelake.session import cut_lineage

BLOCK = 2048
PIVOTS = 64
FEW = 2                # parts of a cell that is longer than a block, while these fit a task
TILE_NUMBERS = 1 << 21 # vector components of one part: 16 MB
ROWS, COLS, FIRST = 1024, 2048, 64    # of the products inside a task
BROADCAST_ROWS = 200_000      # cell statistics are broadcast up to this many rows
ANGLE_SLACK = 1e-5     # wider than the angle error of a cosine rounded to 12 digits


def matrix(col: pa.ChunkedArray) -> np.ndarray:
    arr = col.combine_chunks()
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks)
    flat = arr.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(arr), -1)


def tile_rows(width: int | None, block: int) -> int:
    """Rows of vectors of that many components that one part may have."""
    return max(block, TILE_NUMBERS // max(1, width or 1))


def part_count(n: Column, block: int, tile: int) -> Column:
    """Parts of n rows: those of `block` rows, but no more than FEW while parts fit a tile."""
    return F.least(F.ceil(n / block), F.greatest(F.lit(FEW), F.ceil(n / tile))).cast("int")


def small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a side whose row count was checked."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def choose_pivots(corpus: DataFrame, count: int = PIVOTS) -> np.ndarray:
    """A fixed number of vectors in hash order; the driver gets count x dim numbers."""
    rows = corpus.select("u", F.xxhash64("cid").alias("h"), "cid").orderBy("h", "cid").limit(count)
    return np.array([r["u"] for r in rows.collect()], dtype=np.float64)


def _angles(u: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(u @ pivots.T, -1.0, 1.0))


def _place(df: DataFrame, pivots: np.ndarray, keep_all: bool) -> DataFrame:
    """Add the own cell and its angle; with keep_all also the angles to every pivot."""
    added = {"cell": "int", "ang": "double", **({"pang": "array<double>"} if keep_all else {})}
    schema = df.withColumns({c: F.lit(None).cast(kind) for c, kind in added.items()}).schema

    def run(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            t = pa.Table.from_batches([b])
            a = _angles(matrix(t["u"]), pivots)
            own = a.argmin(axis=1)
            t = t.append_column("cell", pa.array(own.astype(np.int32)))
            t = t.append_column("ang", pa.array(a[np.arange(len(own)), own]))
            if keep_all:
                offs = np.arange(len(own) + 1, dtype=np.int32) * pivots.shape[0]
                t = t.append_column("pang", pa.ListArray.from_arrays(pa.array(offs), pa.array(a.ravel())))
            yield from t.to_batches()

    return df.mapInArrow(run, schema)


class Layout:
    """A corpus (grp, cid, u, ...) cut into cells and parts.

    With grouped=False there is one group, so at most `pivots` cells: their
    statistics become literals and probes meet no table at all.
    """

    def __init__(self, corpus: DataFrame, block: int = BLOCK, pivots: int = PIVOTS, grouped: bool = True):
        self.block, self.grouped = block, grouped
        n, width = corpus.agg(F.count("*"), F.max(F.size("u"))).first()
        self.tile = tile_rows(width, block)
        # pivots=0: no pruning, for vectors that are not of unit length.
        self.pivots = choose_pivots(corpus, pivots) if n > block and pivots else None
        if self.pivots is None:
            placed = corpus.withColumns({"cell": F.lit(0), "ang": F.lit(0.0)})
        else:
            placed = _place(corpus, self.pivots, keep_all=False)
        stats = placed.groupBy("grp", "cell").agg(F.count("*").alias("n"), F.max("ang").alias("radius"))
        stats = stats.withColumn("subs", part_count(F.col("n"), block, self.tile))
        if grouped:
            self.stats = cut_lineage(stats)
            self.stat_rows = self.stats.count()
            sized = placed.join(small(self.stats.select("grp", "cell", "subs"), self.stat_rows), ["grp", "cell"])
        else:
            self.cells = stats.select("cell", "radius", "subs").collect()      # at most `pivots` rows
            self.stat_rows = len(self.cells)
            sized = placed.withColumn("subs", lookup(F.col("cell"), {r.cell: r.subs for r in self.cells}, 1))
        self.corpus = sized.withColumn(
            "sub", F.pmod(F.xxhash64("cid"), F.col("subs")).cast("int")).drop("subs", "ang")

    def visits(self, probes: DataFrame, own_cell_only: bool = False) -> DataFrame:
        """Probe rows repeated for every cell within `reach` (an angle) of the probe.

        Where the statistics have `only`, the one component of a cell, probes of that `comp` leave it out."""
        placed = probes if self.pivots is None else _place(probes, self.pivots, keep_all=True)
        if self.grouped:
            only = [c for c in self.stats.columns if c == "only"]
            st = small(self.stats.select("grp", F.col("cell").alias("_c"), "radius", "subs", *only), self.stat_rows)
            out = placed.join(st, "grp")
            if only:
                out = out.where(~F.col("only").eqNullSafe(F.col("comp"))).drop("only")
        elif not self.cells:
            return placed.select("*", F.lit(0).alias("cell"), F.lit(0).alias("subs")).where(F.lit(False))
        else:
            cells = F.array(*[F.struct(F.lit(r.cell).alias("_c"), F.lit(r.radius).alias("radius"),
                                       F.lit(r.subs).alias("subs")) for r in self.cells])
            out = placed.withColumn("_s", F.explode(cells)).select(
                *placed.columns, "_s._c", "_s.radius", "_s.subs")
        if self.pivots is not None:
            out = out.where(F.col("cell") == F.col("_c") if own_cell_only else
                            F.get("pang", F.col("_c")) - F.col("radius")
                            <= F.col("reach") + ANGLE_SLACK)
            out = out.drop("cell", "ang", "pang")
        return out.withColumnRenamed("_c", "cell").drop("radius")

    def pairs(self, probes: DataFrame, own_cell_only: bool = False):
        """Cogrouped parts (grp, cell, sub, part): probes left, corpus right."""
        v = self.visits(probes, own_cell_only)
        need = part_count(F.col("_n"), self.block, self.tile).alias("parts")
        if self.grouped:
            load = small(v.groupBy("grp", "cell").agg(F.count("*").alias("_n")).select("grp", "cell", need),
                         self.stat_rows)
            split = lambda df: df.join(load, ["grp", "cell"])                       # noqa: E731
        else:
            load = v.groupBy("cell").agg(F.count("*").alias("_n")).select("cell", need).collect()
            parts = lookup(F.col("cell"), {r.cell: r.parts for r in load} or {0: 0}, 0)
            split = lambda df: df.withColumn("parts", parts).where(F.col("parts") > 0)
        left = (split(v).withColumn("part", F.pmod(F.xxhash64("pid"), F.col("parts")).cast("int"))
                .withColumn("sub", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)))
                .drop("parts", "subs"))
        right = (split(self.corpus).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
                 .drop("parts"))
        # Both sides may stem from one frame; fresh aliases keep the cogroup unambiguous.
        right = right.select(*[F.col(c).alias(c) for c in right.columns])
        keys = ["grp", "cell", "sub", "part"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys))


def _best(u: np.ndarray, pid: np.ndarray, v: np.ndarray, cid: np.ndarray, k: int, min_score: float,
          exclude_self: bool, upto: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, column, score) of the best k columns of each row; of equal scores the first columns.

    A block of columns only yields what beats a row's k-th score so far. The blocks grow, so
    that the first one, which has nothing to beat, is small. Columns from `upto` on do not count.
    """
    n = len(u)
    score, col = np.full((n, k), -np.inf), np.full((n, k), -1)
    at, width = 0, FIRST
    while at < len(v):
        # A rounded score that is larger than another is so by a step of the rounding.
        s = u @ v[at:at + width].T
        hit = s > np.maximum(min_score - 1e-12, score[:, -1] + 4e-13)[:, None]
        if upto is not None:
            hit &= np.arange(at, at + s.shape[1]) < upto[:, None]
        r, c = np.divmod(np.flatnonzero(hit), s.shape[1])
        x = np.round(s[r, c], 12)
        keep = (x >= min_score) & (x > score[r, -1]) & np.isfinite(x)
        if exclude_self:
            keep &= pid[r] != cid[at + c]
        r, c, x = r[keep], c[keep] + at, x[keep]
        if len(r):
            rows = np.unique(r)
            of = np.concatenate([np.repeat(rows, k), r])
            x, c = np.concatenate([score[rows].ravel(), x]), np.concatenate([col[rows].ravel(), c])
            order = np.lexsort((c, -x, of))
            take = order[np.searchsorted(of[order], rows)[:, None] + np.arange(k)]
            score[rows], col[rows] = x[take], c[take]
        at, width = at + width, min(2 * width, COLS)
    row, rank = np.nonzero(col >= 0)
    return row, col[row, rank], score[row, rank]


def topk_kernel(k: int, min_score: float, exclude_self: bool, schema: pa.Schema,
                 earlier_only: bool = False):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return schema.empty_table()
        right = right.take(pc.sort_indices(right["cid"]))
        u, v = matrix(left["u"]), matrix(right["u"])
        pid, cid = left["pid"].to_numpy(), right["cid"].to_numpy()
        upto = np.searchsorted(cid, pid) if earlier_only else None
        rows, cols, scores = [], [], []
        for i in range(0, len(u), ROWS):
            part = slice(i, i + ROWS)
            row, col, score = _best(u[part], pid[part], v, cid, k, min_score, exclude_self,
                                    None if upto is None else upto[part])
            rows.append(row + i)
            cols.append(col)
            scores.append(score)
        row, col = pa.array(np.concatenate(rows)), pa.array(np.concatenate(cols))
        return pa.table({"grp": left["grp"].take(row), "pid": left["pid"].take(row),
                         "cid": right["cid"].take(col), "score": pa.array(np.concatenate(scores))}, schema=schema)
    return run


def _arrow(kind: str):
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def prepare(df: DataFrame, id_col: str, vec_col: str, as_id: str, group: str | None = None,
            extra: list[str] | None = None) -> DataFrame:
    """(grp, id, u): unit vectors in double precision; zero and null vectors are dropped."""
    g = F.col(group) if group else F.lit("all")
    named = df.select(g.alias("grp"), F.col(id_col).alias(as_id), F.col(vec_col).alias("_v"), *(extra or []))
    # The vector is normalised once, not in the filter and in the projection.
    return once(named, {"u": unit(F.col("_v"))}, ["grp", as_id, *(extra or [])]).where(F.col("u").isNotNull())


def search(layout: Layout, probes: DataFrame, k: int, min_score: float, exclude_self: bool = False,
           own_cell_only: bool = False, earlier_only: bool = False) -> DataFrame:
    """Best k corpus rows per probe of its group; ties by id. Probes carry `reach`."""
    kinds = dict(probes.dtypes)
    cid_kind = dict(layout.corpus.dtypes)["cid"]
    schema = pa.schema([("grp", _arrow(kinds["grp"])), ("pid", _arrow(kinds["pid"])),
                        ("cid", _arrow(cid_kind)), ("score", pa.float64())])
    ddl = f"grp {kinds['grp']}, pid {kinds['pid']}, cid {cid_kind}, score double"
    part = layout.pairs(probes.select("grp", "pid", "u", "reach"), own_cell_only).applyInArrow(
        topk_kernel(k, min_score, exclude_self, schema, earlier_only), ddl)
    return top_per_key(part, ["grp", "pid"], [F.col("score").desc(), F.col("cid")], k)


def reach_of(min_score: float) -> float:
    return math.acos(max(-1.0, min(1.0, min_score)))


def topk(probes: DataFrame, corpus: DataFrame, k: int, min_score: float,
         earlier_only: bool = False, **layout) -> DataFrame:
    """Exact top-k by cosine at or above min_score for (grp, pid, u) against (grp, cid, u) of one group.

    earlier_only counts only corpus rows with a smaller id than the probe."""
    return search(Layout(corpus.select("grp", "cid", "u"), grouped=False, **layout),
                  probes.withColumn("reach", F.lit(reach_of(min_score))), k, min_score,
                  earlier_only=earlier_only)


def _first_kernel(min_score: float, schema: pa.Schema):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return schema.empty_table()
        right = right.take(pc.sort_indices(right["cid"]))
        u, v = matrix(left["u"]), matrix(right["u"])
        first = np.full(len(u), -1)
        for i in range(0, len(u), ROWS):
            for j in range(0, len(v), COLS):
                open_ = i + np.flatnonzero(first[i:i + ROWS] < 0)
                near = np.round(u[open_] @ v[j:j + COLS].T, 12) >= min_score
                hit = np.flatnonzero(near.any(axis=1))
                first[open_[hit]] = j + near[hit].argmax(axis=1)
        hit = np.flatnonzero(first >= 0)
        return pa.table({"pid": left["pid"].take(pa.array(hit)),
                         "first": right["cid"].take(pa.array(first[hit]))}, schema=schema)
    return run


def earliest_near(probes: DataFrame, min_score: float) -> DataFrame:
    """(pid, first): the smallest id within min_score of each row of (grp, pid, u), itself included."""
    kind = dict(probes.dtypes)["pid"]
    schema = pa.schema([("pid", _arrow(kind)), ("first", _arrow(kind))])
    lay = Layout(probes.select("grp", F.col("pid").alias("cid"), "u"), grouped=False)
    part = lay.pairs(probes.withColumn("reach", F.lit(reach_of(min_score)))).applyInArrow(
        _first_kernel(min_score, schema), f"pid {kind}, first {kind}")
    return part.groupBy("pid").agg(F.min("first").alias("first"))


def knn(vectors: DataFrame, k: int, block: int = BLOCK, pivots: int = PIVOTS,
        layout: Layout | None = None) -> DataFrame:
    """k nearest other vectors inside each group of (grp, cid, u): (grp, pid, cid, score, rank).

    A first search in the own cell bounds the angle of the second one.
    """
    lay = layout or Layout(vectors.select("grp", "cid", "u"), block, pivots)
    probes = vectors.select("grp", F.col("cid").alias("pid"), "u")
    if lay.pivots is None:
        return search(lay, probes.withColumn("reach", F.lit(math.pi)), k, -2.0, exclude_self=True)
    near = search(lay, probes.withColumn("reach", F.lit(math.pi)), k, -2.0, exclude_self=True,
                  own_cell_only=True)
    bound = near.where(F.col("rank") == k).select(
        "grp", "pid", F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("score")))).alias("reach"))
    bounded = probes.join(cut_lineage(bound), ["grp", "pid"], "left").withColumn(
        "reach", F.coalesce("reach", F.lit(math.pi)))
    return search(lay, bounded, k, -2.0, exclude_self=True)
