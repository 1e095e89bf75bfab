"""Measures and choices on given clusters: cohesion, medoid, gate, representatives.

Members are (cluster, number, u) with unit vectors u. A cluster may hold any
share of the rows: sums replace pair sums where an identity allows it, and pair
medians are taken from block products that emit only histogram counts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triagelake.functions import scoring
from triagelake.functions.vectors import dot
from triagelake.operators import blocks
from triagelake.operators.blocks import matrix
from triagelake.operators.keyed import top_per_key
from triagelake.session import cut_lineage

GROUP_LIMIT = 2048        # rows one task may hold of one cluster
BINS = 4096
PASSES = 3                # 4096^3 steps over [-1, 1]: 3e-11 per step
DIGITS = 12               # of a cosine, so that its value does not depend on the block it came from


# ---- vector sums and medoid --------------------------------------------------

def vector_sums(members: DataFrame) -> DataFrame:
    """(cluster, n, s): member count and element-wise vector sum, with map-side partial sums."""
    kind = dict(members.dtypes)["cluster"]

    def partial(batches):
        for b in batches:
            if b.num_rows == 0:
                continue
            codes, names = pd.factorize(b.column("cluster").to_pandas())
            u = matrix(pa.chunked_array([b.column("u")]))
            s = np.zeros((len(names), u.shape[1]))
            np.add.at(s, codes, u)
            offs = np.arange(len(names) + 1, dtype=np.int32) * u.shape[1]
            yield pa.RecordBatch.from_pydict({
                "cluster": pa.array(names, type=b.schema.field("cluster").type),
                "n": pa.array(np.bincount(codes, minlength=len(names)).astype(np.int64)),
                "s": pa.ListArray.from_arrays(pa.array(offs), pa.array(s.ravel()))})

    parts = members.select("cluster", "u").mapInArrow(
        partial, f"cluster {kind}, n bigint, s array<double>")
    long = parts.select("cluster", "n", F.posexplode("s").alias("pos", "x"))
    summed = long.groupBy("cluster", "pos").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    return summed.groupBy("cluster").agg(
        F.max("n").alias("n"),
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda e: e["x"]).alias("s"))


def medoids(members: DataFrame) -> DataFrame:
    """(cluster, medoid): smallest sum of cosine distances, first id on ties.

    Sum over b of (1 - a.b) = n - a.(sum of b), so no pairs are formed.
    """
    j = members.join(vector_sums(members), "cluster")
    cost = F.round(F.col("n") - dot(F.col("u"), F.col("s")), 9)
    return j.groupBy("cluster").agg(
        F.min_by("number", F.struct(cost.alias("c"), F.col("number").alias("i"))).alias("medoid"))


# ---- cohesion -----------------------------------------------------------------

def cohesion(members: DataFrame, limit: int = GROUP_LIMIT) -> DataFrame:
    """(cluster, n, cohesion): median pairwise cosine, 1.0 below two members."""
    sizes = cut_lineage(members.groupBy("cluster").agg(F.count("*").alias("n")))
    kind = dict(members.dtypes)["cluster"]
    pa_kind = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    schema = pa.schema([("cluster", pa_kind), ("cohesion", pa.float64())])

    def one(t: pa.Table) -> pa.Table:
        u = matrix(t["u"])
        m = 1.0 if len(u) < 2 else float(np.median(_cosines(u, u, True)))
        return pa.table({"cluster": t["cluster"].slice(0, 1), "cohesion": [m]}, schema=schema)

    fits = sizes.where(F.col("n") <= limit)
    out = (members.select("cluster", "u").join(fits.select("cluster"), "cluster", "left_semi")
           .groupBy("cluster").applyInArrow(one, f"cluster {kind}, cohesion double"))
    big = sizes.where(F.col("n") > limit)
    if not big.isEmpty():
        out = out.unionByName(_cohesion_large(members, big, limit, kind))
    return sizes.join(out, "cluster")


def _cosines(a: np.ndarray, b: np.ndarray, same: bool) -> np.ndarray:
    """Cosines of all pairs of two blocks, of one block each pair once."""
    return np.concatenate([np.zeros(0), *_cosine_blocks(a, b, same)])


def _cosine_blocks(a: np.ndarray, b: np.ndarray, same: bool):
    """The same a bounded number of pairs at a time."""
    rows = blocks.COLS if same else blocks.ROWS
    for i in range(0, len(a), rows):
        for j in range(i if same else 0, len(b), blocks.COLS):
            s = np.round(a[i:i + rows] @ b[j:j + blocks.COLS].T, DIGITS)
            yield s[np.triu_indices(len(s), k=1, m=s.shape[1])] if same and i == j else s.ravel()


def _cohesion_large(members: DataFrame, sizes: DataFrame, limit: int, kind: str) -> DataFrame:
    """Exact median by selection over block pairs: each pass narrows the two middle
    ranks to one bin of the last one, and a last pass counts what lies below the final
    bins and the values in them, of which rounding leaves few. Tasks emit counts, never pairs."""
    # A row travels once for every part of its cluster, so parts are few and products are made a block at a time.
    tile = blocks.tile_rows(members.agg(F.max(F.size("u"))).first()[0], limit)
    nb = blocks.part_count(F.col("n"), limit, tile)
    m = members.select("cluster", "number", "u").join(sizes.withColumn("nb", nb).drop("n"), "cluster")
    m = m.withColumn("b", F.pmod(F.xxhash64("number"), F.col("nb")).cast("int"))
    left = m.select("cluster", "u", "number", F.col("b").alias("i"),
                    F.explode(F.sequence(F.col("b"), F.col("nb") - 1)).alias("j"))
    right = m.select("cluster", "u", "number", F.col("b").alias("j"),
                     F.explode(F.sequence(F.lit(0), F.col("b"))).alias("i"))
    right = right.select(*[F.col(c).alias(c) for c in right.columns])
    pairs = F.col("n") * (F.col("n") - 1) / 2
    state = sizes.select("cluster", F.explode(F.array(
        F.struct(F.lit(0).alias("w"), (F.floor((pairs - 1) / 2)).alias("r")),
        F.struct(F.lit(1).alias("w"), (F.floor(pairs / 2)).alias("r")))).alias("t"))
    state = state.select("cluster", F.col("t.w").alias("w"), F.col("t.r").alias("r"),
                         F.lit(-1.0000001).alias("lo"), F.lit(1.0000001).alias("hi"))
    pa_kind = pa.int64() if kind == "bigint" else pa.int32() if kind == "int" else pa.string()
    schema = pa.schema([("cluster", pa_kind), ("w", pa.int32()), ("bin", pa.int32()), ("c", pa.int64())])

    def count(l: pa.Table, r: pa.Table) -> pa.Table:
        if l.num_rows == 0 or r.num_rows == 0:
            return schema.empty_table()
        spans = [(l[f"lo{w}"][0].as_py(), l[f"hi{w}"][0].as_py()) for w in (0, 1)]
        counts = np.zeros((2, BINS), np.int64)
        for v in _cosine_blocks(matrix(l["u"]), matrix(r["u"]), l["i"][0].as_py() == l["j"][0].as_py()):
            for w, (lo, hi) in enumerate(spans):
                k = np.floor((v[(v >= lo) & (v <= hi)] - lo) / ((hi - lo) / BINS)).astype(np.int64)
                counts[w] += np.bincount(k[k < BINS], minlength=BINS)
        w, bins = np.nonzero(counts)
        rows = {"w": w.astype(np.int32), "bin": bins.astype(np.int32), "c": counts[w, bins]}
        names = [l["cluster"][0].as_py()] * len(rows["w"])
        return pa.table({"cluster": names, **rows}, schema=schema)

    exact = pa.schema([("cluster", pa_kind), ("w", pa.int32()), ("v", pa.float64()), ("c", pa.int64())])

    def values(l: pa.Table, r: pa.Table) -> pa.Table:
        """Counts of the values within lo..hi, and of all smaller ones as null."""
        if l.num_rows == 0 or r.num_rows == 0:
            return exact.empty_table()
        spans = [(l[f"lo{w}"][0].as_py(), l[f"hi{w}"][0].as_py()) for w in (0, 1)]
        below, inside = [0, 0], [[np.zeros(0)], [np.zeros(0)]]
        for v in _cosine_blocks(matrix(l["u"]), matrix(r["u"]), l["i"][0].as_py() == l["j"][0].as_py()):
            for w, (lo, hi) in enumerate(spans):
                below[w] += int((v < lo).sum())
                inside[w].append(v[(v >= lo) & (v <= hi)])
        rows = {"w": [], "v": [], "c": []}
        for w in (0, 1):
            found, n = np.unique(np.concatenate(inside[w]), return_counts=True)
            rows["w"] += [w] * (1 + len(found))
            rows["v"] += [None, *found.tolist()]
            rows["c"] += [below[w], *n.tolist()]
        return pa.table({"cluster": [l["cluster"][0].as_py()] * len(rows["w"]), **rows}, schema=exact)

    def over_pairs(fn, ddl: str, margin: float = 0.0) -> DataFrame:
        span = state.groupBy("cluster").agg(*[
            F.max(F.when(F.col("w") == w, F.col(c) + m)).alias(f"{c}{w}")
            for w in (0, 1) for c, m in (("lo", -margin), ("hi", margin))])
        # Rows of one block share number order, so the diagonal takes each pair once.
        return left.join(span, "cluster").groupBy("cluster", "i", "j").cogroup(right.groupBy("cluster", "i", "j")) \
            .applyInArrow(_sorted(fn), f"cluster {kind}, {ddl}")

    ranks = state.select("cluster", "w", F.col("r").alias("rank"))
    for _ in range(PASSES):
        state = cut_lineage(state)
        hist = over_pairs(count, "w int, bin int, c bigint")
        hist = hist.groupBy("cluster", "w", "bin").agg(F.sum("c").alias("c"))
        per = hist.groupBy("cluster", "w").agg(                   # at most BINS entries
            F.array_sort(F.collect_list(F.struct("bin", "c"))).alias("h"))
        j = state.join(per, ["cluster", "w"])
        pick = F.aggregate(
            "h", F.struct(F.lit(-1).alias("bin"), F.col("r").alias("left")),
            lambda a, x: F.when((a["bin"] < 0) & (a["left"] < x["c"]),
                                F.struct(x["bin"].alias("bin"), a["left"].alias("left")))
                          .when(a["bin"] < 0, F.struct(F.lit(-1).alias("bin"),
                                                       (a["left"] - x["c"]).alias("left")))
                          .otherwise(a))
        step = (F.col("hi") - F.col("lo")) / BINS
        state = j.select("cluster", "w", pick.alias("p"), "lo", step.alias("step")).select(
            "cluster", "w", F.col("p.left").alias("r"),
            (F.col("lo") + F.col("p.bin") * F.col("step")).alias("lo"),
            (F.col("lo") + (F.col("p.bin") + 1) * F.col("step")).alias("hi"))
    state = cut_lineage(state)
    found = over_pairs(values, "w int, v double, c bigint", margin=1e-11).groupBy("cluster", "w", "v").agg(F.sum("c").alias("c"))
    # The bins span some 50 steps of the rounding, so this window holds few rows; nulls (all below) come first.
    upto = F.sum("c").over(Window.partitionBy("cluster", "w").orderBy(F.col("v").asc_nulls_first()))
    at = found.withColumn("upto", upto).join(ranks, ["cluster", "w"]).where(F.col("v").isNotNull() & (F.col("upto") > F.col("rank")))
    middle = at.groupBy("cluster", "w").agg(F.min("v").alias("v"))
    return middle.groupBy("cluster").agg((F.sum("v") / 2).alias("cohesion"))


def _sorted(fn):
    def run(l: pa.Table, r: pa.Table) -> pa.Table:
        return fn(l.sort_by("number"), r.sort_by("number"))
    return run


# ---- signature, gate, representatives ----------------------------------------

def signatures(members: DataFrame, team: str = "team") -> DataFrame:
    """(cluster, signature): team and the first 12 hex digits of the member list's SHA-1.

    Members are sorted by ranges of (cluster, number), so a large cluster spreads
    over tasks, which join their numbers to texts. The digest, which is defined over
    the whole list, then runs over a few ready texts for each cluster.
    """
    kind = dict(members.dtypes)["cluster"]
    flow = (members.select("cluster", F.col(team).alias("team"), "number")
            .repartitionByRange("cluster", "number").sortWithinPartitions("cluster", "number"))

    def join(frames):
        part = TaskContext.get().partitionId()
        for seq, pdf in enumerate(frames):
            texts = pdf.groupby("cluster", sort=True).agg(team=("team", "first"), text=("number", ",".join)).reset_index()
            yield texts.assign(part=part, seq=seq)

    texts = flow.mapInPandas(join, f"cluster {kind}, team string, text string, part int, seq int")
    ready = texts.repartition("cluster").sortWithinPartitions("cluster", "part", "seq")

    def digest(frames):
        now = run = label = None
        for pdf in frames:
            done = []
            for cl, tm, text in zip(pdf["cluster"], pdf["team"], pdf["text"]):
                if run is not None and cl == now:
                    run.update(f",{text}".encode())
                    continue
                if run is not None:
                    done.append((now, f"{label}_{run.hexdigest()[:12]}"))
                now, label, run = cl, tm, hashlib.sha1(f"{tm}:{text}".encode())
            yield pd.DataFrame(done, columns=["cluster", "signature"])
        if run is not None:
            yield pd.DataFrame({"cluster": [now], "signature": [f"{label}_{run.hexdigest()[:12]}"]})

    return ready.mapInPandas(digest, f"cluster {kind}, signature string")


def quality_gate(clusters: DataFrame, min_cohesion: float = scoring.MIN_COHESION,
                 min_size: int = scoring.MIN_CLUSTER) -> DataFrame:
    return clusters.where((F.col("cohesion") >= min_cohesion) & (F.col("n") >= min_size))


def to_medoid(members: DataFrame, medoid: DataFrame) -> DataFrame:
    """Members with their cosine to the medoid of the cluster."""
    centre = members.select("cluster", F.col("number").alias("medoid"), F.col("u").alias("_mu"))
    m = medoid.join(centre, ["cluster", "medoid"])
    return members.join(m, "cluster").withColumn("sim", F.round(dot(F.col("u"), F.col("_mu")), 9)
                                                 ).drop("_mu")


def representatives(members: DataFrame, medoid: DataFrame, k: int = 4) -> DataFrame:
    """The medoid and its k nearest members per cluster, ranked from 1."""
    j = to_medoid(members, medoid).withColumn("is_medoid", F.col("number") == F.col("medoid"))
    return top_per_key(j, ["cluster"], [F.col("is_medoid").desc(), F.col("sim").desc(), F.col("number")],
                       k + 1).drop("u", "medoid")


def drop_outliers(members: DataFrame, medoid: DataFrame, max_distance: float = 0.4) -> DataFrame:
    return to_medoid(members, medoid).where(1 - F.col("sim") <= max_distance).drop("sim", "medoid")


def spread_days(members: DataFrame, closed_at: str, max_days: int = 60) -> DataFrame:
    s = members.groupBy("cluster").agg(
        F.datediff(F.max(closed_at), F.min(closed_at)).alias("days"), F.count("*").alias("n"))
    return s.withColumn("kept", F.col("days") <= max_days)


def silhouette(members: DataFrame, group: str) -> DataFrame:
    """Mean cosine silhouette per cluster against the other clusters of its group.

    The mean distance of a member to a cluster is one less its product with the
    cluster mean, so members meet means, in parts; a task emits one row per member.
    """
    kind = dict(members.dtypes)["cluster"]
    sums = vector_sums(members)
    of = members.select("cluster", F.col(group).cast("string").alias("grp")).distinct()
    means = cut_lineage(sums.join(of, "cluster").select(
        "grp", F.col("cluster").alias("cid"), "n", F.transform("s", lambda x: x / F.col("n")).alias("u")))
    probes = cut_lineage(members.select(F.col(group).cast("string").alias("grp"), F.col("number").alias("pid"),
                                        F.col("cluster").alias("own"), "u", F.lit(0.0).alias("reach")))
    pid_kind = dict(probes.dtypes)["pid"]
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = pa.schema([("cluster", arrow[kind]), ("number", arrow[pid_kind]), ("a", pa.float64()),
                        ("b", pa.float64())])

    def run(l: pa.Table, r: pa.Table) -> pa.Table:
        if l.num_rows == 0 or r.num_rows == 0:
            return schema.empty_table()
        # The products of one step fit a part.
        rows = max(1, blocks.TILE_NUMBERS // r.num_rows)
        return pa.concat_tables([some(l.slice(i, rows), r) for i in range(0, l.num_rows, rows)])

    def some(l: pa.Table, r: pa.Table) -> pa.Table:
        u = matrix(l["u"])
        d = 1 - u @ matrix(r["u"]).T
        own = l["own"].to_numpy()[:, None] == r["cid"].to_numpy()[None, :]
        n = np.broadcast_to(r["n"].to_numpy()[None, :], d.shape)
        b = np.where(own, np.inf, d).min(axis=1)
        a = np.full(len(d), np.nan)
        i, j = np.nonzero(own & (n > 1))
        # The mean over the others: take the member itself (distance 0) out.
        a[i] = d[i, j] * n[i, j] / (n[i, j] - 1)
        return pa.table({"cluster": l["own"], "number": l["pid"],
                         "a": pa.array(a, from_pandas=True),
                         "b": pa.array(np.where(np.isfinite(b), b, np.nan), from_pandas=True)}, schema=schema)

    parts = blocks.Layout(means, pivots=0).pairs(probes).applyInArrow(
        run, f"cluster {kind}, number {pid_kind}, a double, b double")
    per = parts.groupBy("cluster", "number").agg(F.max("a").alias("a"), F.min("b").alias("b"))
    s = (F.when(F.col("a").isNull() | F.col("b").isNull(), 0.0)
          .otherwise((F.col("b") - F.col("a")) / F.greatest("a", "b", F.lit(1e-12))))
    return per.groupBy("cluster").agg(F.round(F.avg(s), 6).alias("silhouette"))
