"""Block search, cluster measures and density clustering against numpy brute force."""

import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from triagelake.operators import articles, blocks, clusters, density


def frame(spark, u, grp=None, id_col="cid"):
    g = grp if grp is not None else ["all"] * len(u)
    return spark.createDataFrame([(g[i], f"v{i:04d}", u[i].tolist()) for i in range(len(u))],
                                 f"grp string, {id_col} string, vec array<double>")


def prep(spark, u, grp=None):
    return blocks.prepare(frame(spark, u, grp), "cid", "vec", "cid", "grp")


def unit(v):
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@pytest.fixture(scope="module")
def blobs():
    """Skewed data: a third exact copies of one vector, the rest in tight groups and strays."""
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 16))
    pts = np.concatenate([centres[i % 6] + 0.05 * rng.normal(size=16) for i in range(60)]).reshape(60, 16)
    return unit(np.concatenate([np.tile(centres[0], (40, 1)), pts, rng.normal(size=(20, 16))]))


def test_search_with_cells_and_parts(spark, blobs):
    ids = [f"v{i:04d}" for i in range(len(blobs))]
    s = np.round(blobs @ blobs.T, 12)
    want = set()
    for i in range(len(ids)):
        order = sorted((-s[i, j], ids[j]) for j in range(len(ids)) if s[i, j] >= 0.6)[:3]
        want |= {(ids[i], c, r + 1) for r, (_, c) in enumerate(order)}
    v = prep(spark, blobs)
    for grouped in (True, False):
        lay = blocks.Layout(v.select("grp", "cid", "u"), block=16, pivots=5, grouped=grouped)
        probes = v.select("grp", F.col("cid").alias("pid"), "u").withColumn("reach", F.lit(blocks.reach_of(0.6)))
        got = blocks.search(lay, probes, 3, 0.6)
        assert {(r.pid, r.cid, r["rank"]) for r in got.collect()} == want


def test_copies_of_a_vector_do_not_grow_with_the_parts(spark):
    """A vector travels once for each part of the other side, so small blocks do not make many parts."""
    rng = np.random.default_rng(4)
    v = prep(spark, unit(np.eye(8)[0] + 0.1 * rng.normal(size=(900, 8))))
    lay = blocks.Layout(v.select("grp", "cid", "u"), block=16, pivots=3, grouped=False)
    probes = v.select("grp", F.col("cid").alias("pid"), "u").withColumn("reach", F.lit(blocks.reach_of(0.6)))
    sent = lay.pairs(probes).applyInArrow(
        lambda l, r: pa.table({"n": [l.num_rows + r.num_rows]}), "n bigint").agg(F.sum("n")).first()[0]
    assert sent <= 900 * 3 * blocks.FEW + 900 * blocks.FEW


@pytest.mark.parametrize("earlier", [False, True])
def test_best_rows_of_long_parts(earlier):
    """Several blocks of rows and columns with many equal scores: the first ids win, as by a full sort."""
    rng = np.random.default_rng(5)
    u = unit(rng.normal(size=(40, 3)))[rng.integers(0, 40, 2 * blocks.COLS + 300)]
    ids = np.array([f"v{i:05d}" for i in range(len(u))])
    mixed = rng.permutation(len(u))
    schema = pa.schema([("grp", pa.string()), ("pid", pa.string()), ("cid", pa.string()), ("score", pa.float64())])
    side = lambda name, at: pa.table({"grp": ["g"] * len(at), name: ids[at].tolist(), "u": u[at].tolist()})
    kernel = blocks.topk_kernel(7, 0.3, True, schema, earlier_only=earlier)
    got = kernel(side("pid", mixed[:1300]), side("cid", mixed)).to_pylist()
    want = set()
    s = np.round(u @ u.T, 12)
    for i in mixed[:1300]:
        ok = (s[i] >= 0.3) & (np.arange(len(u)) < i if earlier else np.arange(len(u)) != i)
        at = np.flatnonzero(ok)
        want |= {(ids[i], ids[j]) for j in at[np.lexsort((at, -s[i][at]))[:7]]}
    assert {(r["pid"], r["cid"]) for r in got} == want and len(got) == len(want)


def test_knn_by_group(spark, blobs):
    grp = ["a" if i % 3 else "b" for i in range(len(blobs))]
    got = blocks.knn(prep(spark, blobs, grp), 4, block=16, pivots=5).collect()
    s = np.round(blobs @ blobs.T, 12)
    ids = [f"v{i:04d}" for i in range(len(blobs))]
    want = set()
    for i in range(len(ids)):
        order = sorted((-s[i, j], ids[j]) for j in range(len(ids)) if grp[j] == grp[i] and j != i)[:4]
        want |= {(ids[i], c) for _, c in order}
    assert {(r.pid, r.cid) for r in got} == want


def test_zero_and_null_vectors(spark):
    df = spark.createDataFrame([("a", [0.0, 0.0]), ("b", None), ("c", [1.0, 0.0])], "id string, vec array<double>")
    p, c = blocks.prepare(df, "id", "vec", "pid"), blocks.prepare(df, "id", "vec", "cid")
    assert [(r.pid, r.cid) for r in blocks.topk(p, c, 3, 0.0).collect()] == [("c", "c")]


def members(spark, u, cl):
    return spark.createDataFrame([(cl[i], f"m{i:04d}", u[i].tolist()) for i in range(len(u))],
                                 "cluster string, number string, u array<double>")


def test_cohesion_paths_agree(spark, blobs):
    cl = ["one" if i < 70 else "two" for i in range(len(blobs))]
    m = members(spark, blobs, cl)
    want = {}
    for c in ("one", "two"):
        x = blobs[[i for i in range(len(cl)) if cl[i] == c]]
        want[c] = np.median((x @ x.T)[np.triu_indices(len(x), 1)])
    seen = []
    for limit in (2048, 16):                   # one task per cluster; block pairs with histograms
        got = {r.cluster: r.cohesion for r in clusters.cohesion(m, limit).collect()}
        for c in want:
            assert got[c] == pytest.approx(want[c], abs=1e-9), limit
        seen.append(got)
    assert seen[0] == seen[1]                  # the very same numbers
    single = clusters.cohesion(members(spark, blobs[:1], ["x"])).first()
    assert single.cohesion == 1.0 and single.n == 1


def test_cohesion_of_parts_of_several_blocks(spark, monkeypatch):
    """Few parts whatever the limit; their products are made in blocks, a third of the rows are copies."""
    monkeypatch.setattr(clusters.blocks, "ROWS", 8)
    monkeypatch.setattr(clusters.blocks, "COLS", 8)
    rng = np.random.default_rng(6)
    u = unit(np.concatenate([np.tile(np.eye(6)[0], (20, 1)), rng.normal(size=(41, 6))]))
    a, b = (sorted(np.concatenate(list(clusters._cosine_blocks(u, v, same)))) for v, same in ((u, True), (u[:30], False)))
    s = np.round(u @ u.T, 12)
    assert np.allclose(a, sorted(s[np.triu_indices(61, 1)])) and np.allclose(b, sorted(s[:, :30].ravel()))
    got = clusters.cohesion(members(spark, u, ["x"] * 61), limit=4).first()
    assert got.cohesion == pytest.approx(np.median(s[np.triu_indices(61, 1)]), abs=1e-11)
    parts = spark.createDataFrame([(3,), (61,), (40_000,), (3_000_000,)], "n long").select(
        blocks.part_count(F.col("n"), 4, blocks.tile_rows(64, 4)).alias("p"))
    assert [r.p for r in parts.collect()] == [1, 2, 2, 92]


def test_medoid_and_representatives(spark):
    rng = np.random.default_rng(1)
    u = unit(rng.normal(size=8)[None, :] + 0.1 * rng.normal(size=(9, 8)))
    m = members(spark, u, ["c"] * 9)
    d = (1 - u @ u.T).sum(axis=1)
    med = clusters.medoids(m)
    assert med.first().medoid == f"m{int(d.argmin()):04d}"
    reps = [r.number for r in clusters.representatives(m, med).orderBy("rank").collect()]
    near = np.argsort(-(u @ u[d.argmin()]))[:5]
    assert reps == [f"m{i:04d}" for i in near] and len(reps) == 5


def test_signature(spark):
    import hashlib
    df = spark.createDataFrame([("c", "t", n) for n in ("b", "a", "c")], "cluster string, team string, number string")
    assert clusters.signatures(df).first().signature == "t_" + hashlib.sha1(b"t:a,b,c").hexdigest()[:12]


def tree_set(df):
    return {(r.grp, min(r.a, r.b), max(r.a, r.b), round(r.w, 9)) for r in df.collect()}


def test_tree_paths_agree(spark, blobs):
    """One task per team and Boruvka over blocks give the same tree, ties and copies included."""
    grp = ["a" if i % 3 else "b" for i in range(len(blobs))]
    v = density.cut_lineage(prep(spark, blobs, grp))
    small = tree_set(density.spanning_tree(v))
    large = tree_set(density.spanning_tree(v, team_limit=0, block=32, pivots=4))
    assert len(small) == len(blobs) - 2
    assert small == large


def test_tree_by_pairs_and_by_rounds(spark, blobs):
    """Pairs of parts, merged in steps, and Boruvka rounds give the tree of one task; pairs need few jobs."""
    grp = ["a" if i % 3 else "b" for i in range(len(blobs))]
    v = density.cut_lineage(prep(spark, blobs, grp))
    small = tree_set(density.spanning_tree(v))
    spark.sparkContext.setJobGroup("pairs", "pairs")
    pairs = tree_set(density.spanning_tree(v, team_limit=0, block=6, pivots=4))         # up to 14 parts
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("pairs"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert pairs == small and jobs < 60
    assert tree_set(density.spanning_tree(v, team_limit=0, block=32, pivots=4, pair_limit=0)) == small


def test_rounds_against_one_task(spark):
    """Groups far apart, copies and strays: several rounds, in which few vectors are searched, give the tree of one task."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(9, 12)) * 2
    u = unit(np.array([centres[i % 9] + rng.choice([0.02, 0.2, 0.6]) * rng.normal(size=12) for i in range(180)]
                      + [centres[0]] * 7))
    grp = ["a" if i % 4 else "b" for i in range(len(u))]
    v = density.cut_lineage(prep(spark, u, grp))
    searched, pairs = [], blocks.Layout.pairs

    def counted(self, probes, *rest):
        if "comp" in probes.columns:
            searched.append(probes.count())
        return pairs(self, probes, *rest)

    blocks.Layout.pairs = counted
    try:
        got = tree_set(density._tree_large(v, 3, 16, 8, k=4))
    finally:
        blocks.Layout.pairs = pairs
    want = set()
    for g in "ab":
        at = [i for i, x in enumerate(grp) if x == g]
        a, b, w = density._prim(u[at], np.array([f"v{i:04d}" for i in at]), 3)
        want |= {(g, x, y, round(z, 9)) for x, y, z in zip(a.tolist(), b.tolist(), w.tolist())}
    assert got == want
    assert len(searched) > 2 and searched[0] < len(u) / 2, searched


def test_rounds_keep_size_estimates_short(spark, blobs):
    """Spark's estimate of a plan's size does not double its digits with every round and pointer jump."""
    v = density.cut_lineage(prep(spark, blobs, ["a"] * len(blobs)))
    tree = density.spanning_tree(v, team_limit=0, block=32, pivots=4, pair_limit=0)
    size = tree._jdf.queryExecution().optimizedPlan().stats().simpleString()
    power = re.search(r"E\+(\d+)", size)
    assert tree.count() == len(blobs) - 1 and (not power or int(power[1]) < 1000), size


def blob_rows(dim, seed=0):
    rng = np.random.default_rng(seed)
    a = np.eye(dim)[0]
    b = (a + np.eye(dim)[1]) / np.sqrt(2)
    pts = [a + 0.01 * rng.normal(size=dim) for _ in range(6)] + [b + 0.01 * rng.normal(size=dim) for _ in range(7)]
    strays = [np.eye(dim)[5], -np.eye(dim)[6]]
    return [(f"INC{i:03d}", v) for i, v in enumerate(pts + strays)]


@pytest.mark.parametrize("dim", [64, 768])
def test_clusters_of_blobs(spark, dim):
    rows = blob_rows(dim)
    def run(order):
        df = spark.createDataFrame([(n, "team" if i != 99 else "", v.tolist()) for i, (n, v) in enumerate(order)]
                                   + [("LONE", "tiny", [1.0] * dim)], "number string, team string, vec array<double>")
        out = {}
        for r in density.cluster_per_team(df, "number", "vec", "team").collect():
            out.setdefault(r.cluster, set()).add(r.number)
        return sorted(map(sorted, out.values()))
    got = run(rows)
    assert got == [[f"INC{i:03d}" for i in range(6)], [f"INC{i:03d}" for i in range(6, 13)]]
    assert run(rows[::-1]) == got                               # order of the input does not matter


def test_single_group_is_noise_by_default(spark):
    rng = np.random.default_rng(3)
    u = unit(np.eye(8)[0] + 0.01 * rng.normal(size=(6, 8)))
    df = spark.createDataFrame([(f"n{i}", "", x.tolist()) for i, x in enumerate(u)], "number string, team string, vec array<double>")
    assert density.cluster_per_team(df, "number", "vec", "team").count() == 0
    one = density.cluster_per_team(df, "number", "vec", "team", allow_single=True).collect()
    assert len(one) == 6 and {r.team for r in one} == {"_unknown"}


def greedy(u, keys, t):
    made = []
    for i in sorted(range(len(keys)), key=lambda i: keys[i]):
        if all(u[i] @ u[j] < t for j in made):
            made.append(i)
    return {keys[i] for i in made}


def test_creates_in_order(spark, blobs):
    """Greedy in signature order, with a third of the candidates alike."""
    import hashlib
    keys = [hashlib.sha1(str(i).encode()).hexdigest() for i in range(len(blobs))]
    df = spark.createDataFrame([("all", keys[i], blobs[i].tolist()) for i in range(len(blobs))],
                               "grp string, pid string, u array<double>")
    got = {r.pid for r in articles.first_creates(df, 0.80).collect()}
    assert got == greedy(blobs, keys, 0.80)
    assert len(got) < len(blobs) / 2


def test_resolve_new_articles(spark):
    e = np.eye(4)
    mix = lambda a, b, c: (c * a + np.sqrt(1 - c * c) * b)                          # noqa: E731
    rows = [("s1", e[0], None, None, None), ("s2", mix(e[0], e[1], .95), None, None, None),
            ("s3", mix(e[0], e[2], .85), None, None, None), ("s4", e[3], "old", "art", 0.93),
            ("s5", mix(e[3], e[1], .81), None, None, None)]
    df = spark.createDataFrame([(s, u.tolist(), t, a, x) for s, u, t, a, x in rows],
                               "signature string, u array<double>, target_signature string, article_id string, similarity double")
    got = {r.signature: (r.decision, r.target_signature) for r in articles.resolve_new_articles(df).collect()}
    assert got == {"s1": ("create", "s1"), "s2": ("update", "s1"), "s3": ("review", "s1"),
                   "s4": ("update", "old"), "s5": ("create", "s5")}


def partition(rows):
    out = {}
    for r in rows:
        out.setdefault((r.grp, r.label), set()).add(r.number)
    return sorted((g, tuple(sorted(m))) for (g, _), m in out.items())


def top_down(points, edges, min_size):
    """Clusters by the definition: recursive splits from the top, then the better of node and children."""
    def comps(pts, es):
        up = {p: p for p in pts}
        def find(i):
            while up[i] != i:
                i = up[i]
            return i
        for x, y, _ in es:
            up[find(x)] = find(y)
        groups = {}
        for p in pts:
            groups.setdefault(find(p), set()).add(p)
        return list(groups.values())

    def walk(pts, es, birth):
        """(stability, leaves-or-chosen clusters, total) of the cluster that starts with pts."""
        mass, members = 0.0, set(pts)
        while True:
            cut = es[-1]
            lam = min(1 / cut[2], 1e12) if cut[2] > 0 else 1e12
            rest = es[:-1]
            halves = comps(pts, rest)
            big = [h for h in halves if len(h) >= min_size]
            if len(big) == 2:
                mass += lam * len(pts) - birth * len(pts)
                kids = [walk(h, [e for e in rest if e[0] in h], lam) for h in big]
                return mass, members, kids
            lost = len(pts) - sum(len(h) for h in big)
            mass += (lam - birth) * lost
            if not big:
                return mass, members, []
            pts = big[0]
            es = [e for e in rest if e[0] in pts]

    def select(node):
        mass, members, kids = node
        if not kids:
            return mass, [members]
        below = [select(k) for k in kids]
        total = sum(t for t, _ in below)
        if total > mass:
            return total, [m for _, ms in below for m in ms]
        return mass, [members]

    order = sorted(edges, key=lambda e: (e[2], min(e[:2]), max(e[:2])))
    _, _, kids = walk(set(points), order, 0.0)
    return sorted(tuple(sorted(m)) for k in kids for m in select(k)[1])


@pytest.mark.parametrize("seed", range(6))
def test_condense_by_definition(seed):
    rng = np.random.default_rng(seed)
    n = 80
    centres = rng.normal(size=(5, 4)) * 2
    u = unit(np.array([centres[i % 5] + rng.choice([0.05, 0.3, 1.0]) * rng.normal(size=4) for i in range(n)]))
    ids = np.array([f"p{i:03d}" for i in range(n)])
    a, b, w = density._prim(u, ids, 3)
    got = {}
    for p, c in density.condense(a, b, w, 5).items():
        got.setdefault(c, set()).add(p)
    assert sorted(tuple(sorted(m)) for m in got.values()) == top_down(ids, list(zip(a, b, w)), 5)


def test_label_batches_agree(spark, blobs):
    """A few edges at a time give the clusters that all edges at once give."""
    rng = np.random.default_rng(9)
    extra = unit(np.concatenate([np.eye(16)[i % 4] + rng.choice([0.05, 0.4]) * rng.normal(size=(1, 16)) for i in range(50)]))
    u = np.concatenate([blobs, extra])
    grp = ["a" if i % 3 else "b" for i in range(len(u))]
    tree = density.cut_lineage(density.spanning_tree(prep(spark, u, grp)))
    for single in (False, True):
        whole = partition(density.labels_from_tree(tree, 5, single).collect())
        parts = partition(density.labels_from_tree(tree, 5, single, edge_limit=23).collect())
        assert whole == parts and whole
