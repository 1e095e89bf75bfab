"""Density clustering per team (HDBSCAN; Campello, Moulavi, Sander 2013) as Spark jobs.

1. core distance: distance to the min_samples-th other vector (pruned block search);
2. minimum spanning tree of the mutual reachability max(core_a, core_b, d(a, b)):
   small teams in one numpy pass per team, larger teams from the trees of all
   pairs of their parts, the largest by Boruvka rounds over pruned blocks; all
   use the same total order of edges, so the trees agree;
3. the n - 1 tree edges of a team give the condensed tree and its excess-of-mass
   clusters.

Vectors are (grp, cid, u): team, id, unit vector.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.operators import blocks
from triagelake.operators.blocks import matrix
from triagelake.operators.keyed import ordinal
from triagelake.session import cut_lineage, cut_round

MIN_CLUSTER_SIZE, MIN_SAMPLES = 5, 3     # fixed values
TEAM_LIMIT = 2048                        # vectors of a team one task may hold
PAIR_LIMIT = 32_768                      # vectors of a team whose parts are taken by pairs
FOLD = 8                                 # parts that become one when trees are merged
EDGE_LIMIT = 1_000_000                   # tree edges of a team one task may hold
MAX_LAMBDA = 1e12
DIGITS = 12


def eligible(vectors: DataFrame, min_cluster_size: int = MIN_CLUSTER_SIZE) -> DataFrame:
    sizes = vectors.groupBy("grp").agg(F.count("*").alias("n"))
    return vectors.join(sizes.where(F.col("n") >= min_cluster_size).select("grp"), "grp", "left_semi")


def core_distances(vectors: DataFrame, min_samples: int = MIN_SAMPLES,
                   layout: blocks.Layout | None = None, **layout_args) -> DataFrame:
    """(grp, pid, core): distance to the min_samples-th nearest other vector (capped at n - 1)."""
    near = blocks.knn(vectors, min_samples, layout=layout, **layout_args)
    return near.groupBy("grp", "pid").agg(
        F.round(1 - F.min("score"), DIGITS).alias("core"))


def reachability_edges(vectors: DataFrame, k: int, min_samples: int = MIN_SAMPLES) -> DataFrame:
    """Mutual reachability between each vector and its k nearest neighbours."""
    vectors = cut_lineage(vectors)
    near = cut_lineage(blocks.knn(vectors, max(k, min_samples)))
    core = near.where(F.col("rank") <= min_samples).groupBy("grp", "pid").agg(
        F.round(1 - F.min("score"), DIGITS).alias("core"))
    other = core.select("grp", F.col("pid").alias("cid"), F.col("core").alias("core_b"))
    j = near.where(F.col("rank") <= k).join(core, ["grp", "pid"]).join(other, ["grp", "cid"])
    return j.select("grp", F.col("pid").alias("a"), F.col("cid").alias("b"),
                    F.greatest("core", "core_b", F.round(1 - F.col("score"), DIGITS)).alias("w"))


# ---- spanning tree: small teams ---------------------------------------------------

def _distances(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    d = u @ v.T
    np.round(d, DIGITS, out=d)
    np.subtract(1.0, d, out=d)
    return np.round(d, DIGITS, out=d)


def _prim(u: np.ndarray, ids: np.ndarray, min_samples: int):
    """Spanning tree under the total order (weight, lower id, upper id). ids are sorted."""
    d = _distances(u, u)
    np.fill_diagonal(d, np.inf)
    k = min(min_samples, len(u) - 1)
    lo, hi, w = _grow(d, np.partition(d, k - 1, axis=1)[:, k - 1])
    return ids[lo], ids[hi], w


def _grow(d: np.ndarray, core: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower, upper, weight) of the tree of all points of a distance matrix, which becomes the reachability."""
    n = len(d)
    np.maximum(d, core[:, None], out=d)
    np.maximum(d, core[None, :], out=d)
    best, lo, hi = np.full(n, np.inf), np.full(n, n), np.full(n, n)
    outside = np.ones(n, dtype=bool)
    at, edges = 0, []
    idx = np.arange(n)
    for _ in range(n - 1):
        outside[at], best[at] = False, np.inf
        w = d[at]
        better = w < best
        ties = np.flatnonzero((w == best) & outside)
        if len(ties):
            a, b = np.minimum(ties, at), np.maximum(ties, at)
            better[ties] = (a < lo[ties]) | ((a == lo[ties]) & (b < hi[ties]))
        better &= outside
        np.copyto(best, w, where=better)
        np.copyto(lo, np.minimum(idx, at), where=better)
        np.copyto(hi, np.maximum(idx, at), where=better)
        low = np.flatnonzero(best == best.min())
        pick = low[0] if len(low) == 1 else low[np.lexsort((hi[low], lo[low]))[0]]
        edges.append((lo[pick], hi[pick], best[pick]))
        at = pick
    e = np.array(edges)
    return e[:, 0].astype(int), e[:, 1].astype(int), e[:, 2]


def _kinds(vectors: DataFrame):
    t = dict(vectors.dtypes)
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    ddl = f"grp {t['grp']}, a {t['cid']}, b {t['cid']}, w double"
    return ddl, pa.schema([("grp", arrow[t["grp"]]), ("a", arrow[t["cid"]]),
                           ("b", arrow[t["cid"]]), ("w", pa.float64())])


def _tree_small(vectors: DataFrame, min_samples: int) -> DataFrame:
    ddl, schema = _kinds(vectors)

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("cid")
        if t.num_rows < 2:
            return schema.empty_table()
        a, b, w = _prim(matrix(t["u"]), t["cid"].to_numpy(), min_samples)
        return pa.table({"grp": [t["grp"][0].as_py()] * len(w), "a": a.tolist(), "b": b.tolist(),
                         "w": w}, schema=schema)

    return vectors.select("grp", "cid", "u").groupBy("grp").applyInArrow(run, ddl)


# ---- spanning tree: parts by pairs --------------------------------------------------

def _forest(a: np.ndarray, b: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The edges that join two components when they are taken in order."""
    ids, x, y, w = _in_order(a, b, w)
    up, keep = list(range(len(ids))), []

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for e, (i, j) in enumerate(zip(x.tolist(), y.tolist(), strict=True)):
        p, q = root(i), root(j)
        if p != q:
            up[p] = q
            keep.append(e)
    x, y = x[keep], y[keep]
    return ids[np.minimum(x, y)], ids[np.maximum(x, y)], w[keep]


def _tree_pairs(vectors: DataFrame, min_samples: int, rows: int, block: int, pivots: int) -> DataFrame:
    """Trees of all pairs of a team's parts, merged.

    An edge of the tree is in the tree of any two parts that hold its ends, because a
    path of lighter edges there would be one in the team as well. A task holds two parts, or
    the trees of FOLD parts with FOLD others.
    """
    ddl, schema = _kinds(vectors)
    keyed = pa.schema([schema.field("grp"), ("i", pa.int32()), ("j", pa.int32()), *list(schema)[1:]])
    keyed_ddl = ddl.replace(", a ", ", i int, j int, a ", 1)

    def table(t: pa.Table, a, b, w) -> pa.Table:
        n = len(w)
        return pa.table({c: t[c].slice(0, 1).take(pa.array(np.zeros(n, np.int64))) for c in ("grp", "i", "j")}
                        | {"a": a.tolist(), "b": b.tolist(), "w": w}, schema=keyed)

    def pair(t: pa.Table) -> pa.Table:
        if t.num_rows < 2:
            return keyed.empty_table()
        t = t.sort_by("cid")
        ids = t["cid"].to_numpy()
        u = matrix(t["u"])
        lo, hi, w = _grow(_distances(u, u), np.round(1.0 - t["least"].to_numpy(), DIGITS))
        return table(t, ids[lo], ids[hi], w)

    def merge(t: pa.Table) -> pa.Table:
        return table(t, *_forest(t["a"].to_numpy(), t["b"].to_numpy(), t["w"].to_numpy()))

    least = blocks.knn(vectors, min_samples, block, pivots).groupBy("grp", F.col("pid").alias("cid")).agg(
        F.min("score").alias("least"))
    sizes = cut_lineage(vectors.groupBy("grp").agg(F.ceil(F.count("*") / rows).cast("int").alias("parts")))
    side = sizes.agg(F.max("parts")).first()[0] or 1
    own = F.pmod(F.xxhash64("cid"), F.col("parts")).cast("int")
    dealt = vectors.select("grp", "cid", "u").join(least, ["grp", "cid"]).join(sizes, "grp").withColumn("own", own)
    others = F.filter(F.sequence(F.lit(0), F.col("parts") - 1), lambda x: (x != F.col("own")) | (F.col("parts") == 1))
    dealt = dealt.withColumn("other", F.explode(others)).select(
        "grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "cid", "u", "least")
    tree = dealt.groupBy("grp", "i", "j").applyInArrow(pair, keyed_ddl)
    while side > 1:
        side = -(-side // FOLD)
        tree = tree.withColumns({c: F.floor(F.col(c) / FOLD).cast("int") for c in ("i", "j")}) \
            .groupBy("grp", "i", "j").applyInArrow(merge, keyed_ddl)
    return tree.drop("i", "j")


# ---- spanning tree: teams of any size ----------------------------------------------

def _edge(a, b, w):
    return F.struct(F.col(w).alias("w"), F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"))


def _foreign_kernel(ddl_types):
    """Lightest edge of each left component to another component inside one pair of parts."""
    schema = pa.schema([("grp", ddl_types["grp"]), ("comp", ddl_types["id"]), ("w", pa.float64()),
                        ("lo", ddl_types["id"]), ("hi", ddl_types["id"]), ("other", ddl_types["id"])])

    def lightest(comp, w, lo, hi, other):
        """The first edge of each component in the order of edges."""
        o = np.lexsort((hi, lo, w, comp))
        o = o[np.flatnonzero(np.diff(comp[o], prepend=-1))]
        return comp[o], w[o], lo[o], hi[o], other[o]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return schema.empty_table()
        n = left.num_rows
        # Numbers in the order of the ids stand for them.
        ids, at = np.unique(np.concatenate([left["pid"].to_numpy(), right["cid"].to_numpy()]), return_inverse=True)
        comps, of = np.unique(np.concatenate([left["comp"].to_numpy(), right["comp"].to_numpy()]), return_inverse=True)
        # Rows of a component lie together, so that most blocks without a foreign row are seen as such.
        x, y = np.argsort(of[:n], kind="stable"), np.argsort(of[n:], kind="stable")
        u, v = matrix(left["u"])[x], matrix(right["u"])[y]
        core_u, core_v = left["core"].to_numpy()[x], right["core"].to_numpy()[y]
        of_u, of_v, at_u, at_v = of[:n][x], of[n:][y], at[:n][x], at[n:][y]
        best = [np.zeros(0, t) for t in (np.int64, np.float64, np.int64, np.int64, np.int64)]
        for i in range(0, n, blocks.ROWS):
            r = slice(i, min(n, i + blocks.ROWS))
            for j in range(0, len(v), blocks.COLS):
                c = slice(j, j + blocks.COLS)
                ca, cb = of_u[r], of_v[c]
                if ca[0] == ca[-1] == cb[0] == cb[-1]:
                    continue
                w = _distances(u[r], v[c])
                np.maximum(w, core_u[r][:, None], out=w)
                np.maximum(w, core_v[c][None, :], out=w)
                w[ca[:, None] == cb[None, :]] = np.inf
                low = w.min(axis=1)
                # Ties of one row: every candidate at the minimum, ordered by the pair.
                x, y = np.nonzero((w == low[:, None]) & np.isfinite(low)[:, None])
                a, b = at_u[r][x], at_v[c][y]
                found = lightest(ca[x], low[x], np.minimum(a, b), np.maximum(a, b), cb[y])
                best = lightest(*[np.concatenate(p) for p in zip(best, found, strict=True)])
        comp, w, lo, hi, other = best
        return pa.table({"grp": [left["grp"][0].as_py()] * len(w), "comp": comps[comp].tolist(), "w": w,
                         "lo": ids[lo].tolist(), "hi": ids[hi].tolist(), "other": comps[other].tolist()}, schema=schema)
    return run


def _tree_large(vectors: DataFrame, min_samples: int, block: int, pivots: int, k: int = 8) -> DataFrame:
    """Boruvka: each round adds the lightest outgoing edge of every component but the largest.

    An edge that is in no list of k neighbours weighs at least as much as the end of both ends'
    lists (`horizon`). So a vector is searched only if its list ends before the lightest known
    edge of its component; that bound also prunes the cells it has to visit. Known edges are
    kept between components only, one for each pair. Components merge by pointer jumping. At
    most log2(n) rounds; every round is cut by a reliable checkpoint.
    """
    t = dict(vectors.dtypes)
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    types = {"grp": arrow[t["grp"]], "id": arrow[t["cid"]]}
    layout = blocks.Layout(vectors.select("grp", "cid", "u"), block, pivots)
    k = max(k, min_samples)
    near = cut_lineage(blocks.knn(vectors, k, layout=layout))
    ends = near.groupBy("grp", F.col("pid").alias("cid")).agg(
        F.round(1 - F.min(F.when(F.col("rank") <= min_samples, F.col("score"))), DIGITS).alias("core"),
        # A list of fewer than k holds all others; no edge weighs 3.
        F.when(F.count("*") < k, 3.0).otherwise(F.round(1 - F.min("score"), DIGITS)).alias("horizon"))
    nodes = cut_lineage(vectors.join(ends, ["grp", "cid"]))
    placed, stats = cut_lineage(layout.corpus), layout.stats
    core = nodes.select("grp", F.col("cid").alias("pid"), "core")
    other_core = nodes.select("grp", "cid", F.col("core").alias("core_b"))
    known = near.join(core, ["grp", "pid"]).join(other_core, ["grp", "cid"]).select(
        "grp", F.least("pid", "cid").alias("ca"), F.greatest("pid", "cid").alias("cb"),
        F.greatest("core", "core_b", F.round(1 - F.col("score"), DIGITS)).alias("w"),
        F.least("pid", "cid").alias("lo"), F.greatest("pid", "cid").alias("hi"))

    ddl = f"grp {t['grp']}, comp {t['cid']}, w double, lo {t['cid']}, hi {t['cid']}, other {t['cid']}"
    edge = F.struct("w", "lo", "hi", "other")
    label = nodes.select("grp", "cid", F.col("cid").alias("comp"))
    tree = None
    while True:
        sizes = label.groupBy("grp", "comp").agg(F.count("*").alias("n"))
        open_grps = sizes.groupBy("grp").agg(F.count("*").alias("c"), F.max(F.struct("n", "comp")).alias("most"))
        open_grps = cut_round(open_grps.where(F.col("c") > 1).select("grp", F.col("most.comp").alias("most")))
        if open_grps.isEmpty():
            break
        known = cut_round(known.groupBy("grp", "ca", "cb").agg(F.min(F.struct("w", "lo", "hi")).alias("e")).select(
            "grp", "ca", "cb", "e.*"))
        both = known.withColumnsRenamed({"ca": "comp", "cb": "other"}).unionByName(
            known.withColumnsRenamed({"cb": "comp", "ca": "other"}))
        best = cut_round(both.join(open_grps, "grp").where(F.col("comp") != F.col("most")).groupBy("grp", "comp").agg(
            F.min(edge).alias("e")).select("grp", "comp", "e.*"))
        now = nodes.join(label, ["grp", "cid"]).join(open_grps, "grp")
        probes = now.where(F.col("comp") != F.col("most")).join(
            best.select("grp", "comp", F.col("w").alias("bound")), ["grp", "comp"], "left").select(
            "grp", F.col("cid").alias("pid"), "u", "core", "horizon", "comp",
            F.coalesce("bound", F.lit(2.0)).alias("bound"))
        probes = probes.where(F.col("horizon") <= F.col("bound")).withColumn(
            "reach", F.acos(F.greatest(F.lit(-1.0), 1 - F.col("bound")))).drop("bound", "horizon")
        layout.corpus = placed.join(now.select("grp", "cid", "core", "comp"), ["grp", "cid"])
        # Cells that hold one component only have nothing for that component.
        lone = layout.corpus.groupBy("grp", "cell").agg(F.min("comp").alias("only"), F.max("comp").alias("last"))
        layout.stats = cut_round(stats.join(lone, ["grp", "cell"]).withColumn(
            "only", F.when(F.col("only") == F.col("last"), F.col("only"))).drop("last"))
        found = layout.pairs(cut_lineage(probes)).applyInArrow(_foreign_kernel(types), ddl)
        pick = best.unionByName(found).groupBy("grp", "comp").agg(F.min(edge).alias("e")).select("grp", "comp", "e.*")
        pick = cut_round(pick)
        chosen = pick.groupBy("grp", F.col("lo").alias("a"), F.col("hi").alias("b")).agg(F.min("w").alias("w"))
        tree = chosen if tree is None else tree.unionByName(chosen)
        root = _roots(pick)
        label = cut_round(label.join(root, ["grp", "comp"], "left").select(
            "grp", "cid", F.coalesce("to", "comp").alias("comp")))
        for end in ("ca", "cb"):
            known = known.join(root.withColumnRenamed("comp", end), ["grp", end], "left").withColumn(
                end, F.coalesce("to", end)).drop("to")
        known = known.where(F.col("ca") != F.col("cb")).select(
            "grp", F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb"), "w", "lo", "hi")
    ddl_edges, _ = _kinds(vectors)
    if tree is None:
        return vectors.sparkSession.createDataFrame([], ddl_edges)
    return tree.distinct()


def _roots(pick: DataFrame) -> DataFrame:
    """(grp, comp, to): hook every component to its partner, then jump to the root.

    Under a total order of edges the only cycles are pairs that chose each other;
    the smaller id of such a pair becomes the root. A component without an edge is one as well.
    """
    hook = pick.select("grp", "comp", F.col("other").alias("to"))
    back = hook.select("grp", F.col("comp").alias("to"), F.col("to").alias("back"))
    ptr = hook.join(back, ["grp", "to"], "left").select(
        "grp", "comp", F.when((F.col("back") == F.col("comp")) & (F.col("comp") < F.col("to")),
                              F.col("comp")).otherwise(F.col("to")).alias("to"))
    ptr = cut_round(ptr)
    while True:
        up = ptr.select("grp", F.col("comp").alias("to"), F.col("to").alias("to2"))
        jumped = cut_round(ptr.join(up, ["grp", "to"], "left").select(
            "grp", "comp", F.coalesce("to2", "to").alias("to2"), "to"))
        moved = jumped.where(F.col("to") != F.col("to2")).limit(1).count()
        ptr = jumped.select("grp", "comp", F.col("to2").alias("to"))
        if not moved:
            return ptr


def spanning_tree(vectors: DataFrame, min_samples: int = MIN_SAMPLES, team_limit: int = TEAM_LIMIT,
                  block: int = blocks.BLOCK, pivots: int = blocks.PIVOTS, pair_limit: int = PAIR_LIMIT) -> DataFrame:
    """(grp, a, b, w): n - 1 edges per team, a < b."""
    sizes = cut_lineage(vectors.groupBy("grp").agg(F.count("*").alias("n")).where(F.col("n") > team_limit))
    large = sizes.select("grp")
    if large.isEmpty():
        return _tree_small(vectors, min_samples)
    tree = _tree_small(vectors.join(large, "grp", "left_anti"), min_samples)
    by_pairs, by_rounds = F.col("n") <= pair_limit, F.col("n") > pair_limit
    for which, grow in ((by_pairs, lambda v: _tree_pairs(v, min_samples, min(block, TEAM_LIMIT), block, pivots)),
                        (by_rounds, lambda v: _tree_large(v, min_samples, block, pivots))):
        if not sizes.where(which).isEmpty():
            tree = tree.unionByName(grow(cut_lineage(vectors.join(sizes.where(which).select("grp"), "grp", "left_semi"))))
    return tree


# ---- cluster tree ----------------------------------------------------------------

class _Part:
    """A component while edges are merged: its size, its open cluster with the sums
    of that cluster, and its points as long as it has too few for a cluster."""

    __slots__ = ("size", "cid", "mass", "count", "below", "loose")

    def __init__(self, size, cid, mass, count, below, loose):
        self.size, self.cid, self.mass, self.count, self.below, self.loose = (
            size, cid, mass, count, below, loose)


LEAF = -1.0      # `below` of a cluster without children


def _settle(part: _Part, birth: float, selectable: bool = True) -> tuple[bool, float]:
    """(chosen, total) of a cluster that ends downwards at density `birth`.

    Its stability sums, over the points it loses, the density at which they leave
    less `birth`; it is chosen unless its children's total is larger.
    """
    stability = part.mass - birth * part.count
    if part.below == LEAF:
        return selectable, stability
    chosen = selectable and part.below <= stability
    return chosen, stability if chosen else part.below


def merge_edges(x, y, w, parts: list[_Part], min_size: int, tag: str):
    """Merge components along edges in the given order (rising weight).

    A cluster appears when a component first has min_size points. A merge of two
    components with clusters closes both and opens their parent; any smaller side
    loses its points to the cluster at that density. Returns the root of every
    component, (point, cluster) pairs and closed clusters (id, parent, chosen).
    """
    up = list(range(len(parts)))
    joined, closed, made = [], [], 0

    def root(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for i, j, d in zip(x, y, w):
        lam = min(1.0 / d, MAX_LAMBDA) if d > 0 else MAX_LAMBDA
        p, q = root(i), root(j)
        if parts[p].size < parts[q].size:
            p, q = q, p
        a, b = parts[p], parts[q]
        size = a.size + b.size
        if a.cid is not None and b.cid is not None:
            made += 1
            cid, total = f"{tag}.{made}", 0.0
            for side in (a, b):
                chosen, t = _settle(side, lam)
                closed.append((side.cid, cid, chosen))
                total += t
            merged = _Part(size, cid, lam * size, size, total, [])
        elif a.cid is not None or b.cid is not None:
            own, lost = (a, b) if a.cid is not None else (b, a)
            joined += [(point, own.cid) for point in lost.loose]
            merged = _Part(size, own.cid, own.mass + lam * len(lost.loose), own.count + len(lost.loose),
                           own.below, [])
        elif size >= min_size:
            made += 1
            cid = f"{tag}.{made}"
            joined += [(point, cid) for point in a.loose + b.loose]
            merged = _Part(size, cid, lam * size, size, LEAF, [])
        else:
            merged = _Part(size, None, 0.0, 0, LEAF, a.loose + b.loose)
        up[q] = p
        parts[p] = merged
    return [root(i) for i in range(len(parts))], joined, closed


def _in_order(a, b, w):
    """(ids, x, y, w) of edges sorted by (weight, lower id, upper id)."""
    ids, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[:len(w)], ends[len(w):]
    o = np.lexsort((np.maximum(x, y), np.minimum(x, y), w))
    return ids, x[o], y[o], w[o]


def condense(a: np.ndarray, b: np.ndarray, w: np.ndarray, min_size: int,
             allow_single: bool = False) -> dict:
    """point -> cluster of one team from all its tree edges; noise is left out."""
    ids, x, y, w = _in_order(a, b, w)
    parts = [_Part(1, None, 0.0, 0, LEAF, [i]) for i in ids]
    roots, joined, closed = merge_edges(x, y, w, parts, min_size, "c")
    top = parts[roots[0]]
    if top.cid is None:
        return {}
    closed.append((top.cid, None, _settle(top, 0.0, allow_single)[0]))
    owner: dict = {}
    for cid, parent, chosen in reversed(closed):          # parents come first
        owner[cid] = owner.get(parent) or (cid if chosen else None)
    return {point: owner[cid] for point, cid in joined if owner[cid]}


def labels_from_tree(tree: DataFrame, min_size: int = MIN_CLUSTER_SIZE, allow_single: bool = False,
                     edge_limit: int = EDGE_LIMIT) -> DataFrame:
    """(grp, number, label) of clustered points from n - 1 edges per team; a cluster is named by its smallest member."""
    found = cut_lineage(_labels(tree, min_size, allow_single, edge_limit))
    first = found.groupBy("grp", "label").agg(F.min("number").cast("string").alias("_first"))
    return found.join(first, ["grp", "label"]).select("grp", "number", F.col("_first").alias("label"))


def _labels(tree: DataFrame, min_size: int, allow_single: bool, edge_limit: int) -> DataFrame:
    t = dict(tree.dtypes)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        got = condense(pdf["a"].to_numpy(), pdf["b"].to_numpy(), pdf["w"].to_numpy(), min_size, allow_single)
        return pd.DataFrame({"grp": [pdf["grp"].iloc[0]] * len(got), "number": list(got),
                             "label": list(got.values())}, dtype=object)

    sizes = tree.groupBy("grp").agg(F.count("*").alias("n"))
    large = cut_lineage(sizes.where(F.col("n") > edge_limit).select("grp"))
    ddl = f"grp {t['grp']}, number {t['a']}, label string"
    if large.isEmpty():
        return tree.groupBy("grp").applyInPandas(run, ddl)
    few = tree.join(large, "grp", "left_anti").groupBy("grp").applyInPandas(run, ddl)
    return few.unionByName(_labels_large(tree.join(large, "grp", "left_semi"), min_size, allow_single,
                                         edge_limit))


def _labels_large(tree: DataFrame, min_size: int, allow_single: bool, edge_limit: int) -> DataFrame:
    """The same for teams of any size: edges in weight order, edge_limit at a time.

    Between batches only components travel: size, open cluster, its sums. A task
    holds one batch of one team; points are written out as they join a cluster.
    The final cluster of a point is the highest chosen ancestor of the cluster it
    joined, found by pointer jumping over the cluster table.
    """
    kind = dict(tree.dtypes)
    pid, grp = kind["a"], kind["grp"]
    ranked = ordinal(tree.select("grp", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "w"),
                     ["grp"], ["w", "a", "b"], "_i")
    ranked = cut_lineage(ranked.withColumn("batch", F.floor((F.col("_i") - 1) / edge_limit)))
    batches = ranked.agg(F.max("batch")).first()[0] + 1
    part_cols = "size bigint, cid string, mass double, count bigint, below double"
    label = cut_lineage(tree.select("grp", F.explode(F.array("a", "b")).alias("point")).distinct()
                        .withColumn("comp", F.col("point")))
    state = tree.sparkSession.createDataFrame([], f"grp {grp}, comp {pid}, {part_cols}, loose array<{pid}>")
    out_ddl = (f"kind string, grp {grp}, comp {pid}, root {pid}, {part_cols}, loose array<{pid}>, "
               "parent string, chosen boolean")
    names = [c.split(" ")[0] for c in out_ddl.split(", ")]
    joined = closed = None

    def step(key, edges: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(edges):
            e = edges.sort_values(["w", "a", "b"], kind="stable")
            comps, ends = np.unique(np.concatenate([e["ca"], e["cb"]]), return_inverse=True)
            at = {r.comp: _Part(int(r.size_), r.cid, r.mass, int(r.count_), r.below, list(r.loose))
                  for r in known.rename(columns={"size": "size_", "count": "count_"}).itertuples()}
            parts = [at.get(c) or _Part(1, None, 0.0, 0, LEAF, [c]) for c in comps]
            roots, new, ended = merge_edges(ends[:len(e)], ends[len(e):], e["w"].to_numpy(), parts, min_size,
                                            f"b{e['batch'].iloc[0]}")
            g = key[0]
            for i, r in enumerate(roots):
                rows.append({"kind": "map", "grp": g, "comp": comps[i], "root": comps[r]})
            for r in sorted(set(roots)):
                p = parts[r]
                rows.append({"kind": "state", "grp": g, "comp": comps[r], "size": p.size, "cid": p.cid,
                             "mass": p.mass, "count": p.count, "below": p.below, "loose": p.loose})
            rows += [{"kind": "join", "grp": g, "comp": point, "cid": cid} for point, cid in new]
            rows += [{"kind": "end", "grp": g, "cid": c, "parent": up, "chosen": bool(ok)} for c, up, ok in ended]
        out = pd.DataFrame(rows, columns=names)
        return out.astype({"size": "Int64", "count": "Int64"}).astype(object).where(out.notna(), None)

    for n in range(batches):
        e = ranked.where(F.col("batch") == n)
        la = label.select("grp", F.col("point").alias("a"), F.col("comp").alias("ca"))
        lb = label.select("grp", F.col("point").alias("b"), F.col("comp").alias("cb"))
        e = cut_lineage(e.join(la, ["grp", "a"]).join(lb, ["grp", "b"]).select(
            "grp", "a", "b", "w", "ca", "cb", "batch"))
        touched = e.select("grp", F.explode(F.array("ca", "cb")).alias("comp")).distinct()
        mine = state.join(touched, ["grp", "comp"], "left_semi")
        mine = mine.select(*[F.col(c).alias(c) for c in mine.columns])
        got = cut_round(e.groupBy("grp").cogroup(mine.groupBy("grp")).applyInPandas(step, out_ddl))
        moved = got.where("kind = 'map'").select("grp", "comp", "root")
        label = cut_round(label.join(moved, ["grp", "comp"], "left").select(
            "grp", "point", F.coalesce("root", "comp").alias("comp")))
        state = cut_round(state.join(touched, ["grp", "comp"], "left_anti").unionByName(
            got.where("kind = 'state'").select(*state.columns)))
        j = got.where("kind = 'join'").select("grp", F.col("comp").alias("number"), "cid")
        c = got.where("kind = 'end'").select("grp", "cid", "parent", "chosen")
        joined = j if joined is None else joined.unionByName(j)
        closed = c if closed is None else closed.unionByName(c)

    # One component per team is left; its cluster is the top one.
    chosen_top = (F.lit(allow_single) & ((F.col("below") == LEAF) | (F.col("below") <= F.col("mass"))))
    top = state.where(F.col("cid").isNotNull()).select(
        "grp", "cid", F.lit(None).cast("string").alias("parent"), chosen_top.alias("chosen"))
    tops = closed.unionByName(top).select(
        "grp", "cid", F.col("parent").alias("ptr"), F.when(F.col("chosen"), F.col("cid")).alias("best"))
    tops = cut_lineage(tops)
    while not tops.where(F.col("ptr").isNotNull()).isEmpty():
        above = tops.select("grp", F.col("cid").alias("ptr"), F.col("ptr").alias("ptr2"),
                            F.col("best").alias("best2"))
        tops = cut_round(tops.join(above, ["grp", "ptr"], "left").select(
            "grp", "cid", F.col("ptr2").alias("ptr"), F.coalesce("best2", "best").alias("best")))
    return joined.join(tops.where(F.col("best").isNotNull()), ["grp", "cid"]).select(
        "grp", "number", F.col("best").alias("label"))


def cluster_per_team(vectors: DataFrame, id_col: str, vec_col: str, team_col: str,
                     min_cluster_size: int = MIN_CLUSTER_SIZE, min_samples: int = MIN_SAMPLES,
                     allow_single: bool = False, team_limit: int = TEAM_LIMIT,
                     block: int = blocks.BLOCK, pivots: int = blocks.PIVOTS,
                     edge_limit: int = EDGE_LIMIT) -> DataFrame:
    """(team, number, cluster, u) of clustered rows; noise and small teams are left out."""
    named = vectors.withColumn("_team", F.when(F.length(team_col) > 0, F.col(team_col))
                               .otherwise("_unknown"))
    v = cut_lineage(eligible(blocks.prepare(named, id_col, vec_col, "cid", "_team"), min_cluster_size))
    # The sizes of the trees are counted first, so the trees are stored.
    tree = cut_lineage(spanning_tree(v, min_samples, team_limit, block, pivots))
    lab = cut_lineage(labels_from_tree(tree, min_cluster_size, allow_single, edge_limit))
    return (lab.join(v.select("grp", F.col("cid").alias("number"), "u"), ["grp", "number"])
               .select(F.col("grp").alias("team"), "number",
                       F.concat_ws("#", "grp", F.col("label")).alias("cluster"), "u"))
