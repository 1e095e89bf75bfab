"""Approximate nearest neighbours: NN-descent builds a graph, queries search it greedily.

Index. Equal vectors are one node, so copies cost nothing and lose nothing. The
first neighbours of a node come from the leaves of random projection trees (cut on
a bounded sample, all nodes sorted in). Then, round by round, every node joins its
neighbours, forward and reverse, with each other: a neighbour of a neighbour that is
nearer than a node's worst neighbour takes its place. Only pairs with an edge that
is new since the last round are looked at, and only improvements are shuffled. A
node with many reverse neighbours has them split into buckets, anew in each round, so
that any two of them come to meet. Distances are sums of squared differences in double
precision; building ends when few edges change.

Search. A query starts at its own node, where its vector is indexed, and at the
nearest of some pivots. Each round opens the nearest unopened nodes of
its beam and adds their neighbours, until all of the beam is opened. Trees, pivots and
beam grow with the logarithm of the number of vectors. Vectors and links are tables in
buckets of their node, so that a round shuffles what it asks for and not them; the
tables are named `ann_...`, stand in the warehouse and are dropped with the index.

Rows: vectors that are null, empty, zero, of another length than most (ties: the
longer), or hold a null or non-finite component take no part, as candidate or as
query. Repeated ids are kept as rows. Equal distances are ranked by id. Fewer
candidates than asked for are all returned. Empty tables give empty results.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triagelake.llm.common import Batches, arrow_type, batch, map_arrow, shuffle_partitions, stored

NEIGHBOURS = 32         # edges of a node
TREES = 4
LEAF = 128              # nodes of a leaf, on average
BLOCK = 512             # nodes of a leaf that meet in one task
SAMPLE = 20_000         # vectors the trees are cut on
BUCKET = 96             # neighbours that meet in one local join
ROUNDS = 8
CHANGED = 0.005         # share of new edges at which building ends
BEAM, OPENED = 160, 24  # nodes a query keeps, and opens in a round
PIVOTS = 256
GROWS_FROM = 25_000     # vectors from which trees, beam and pivots grow


def grown(base: int, n: int) -> int:
    """`base`, and an eighth of it for each doubling of the number of vectors."""
    return round(base * (1 + math.log2(max(n, GROWS_FROM) / GROWS_FROM) / 8))


@dataclass
class Index:
    members: DataFrame      # (node, id): every indexed row
    nodes: DataFrame        # (node, v): vector in double precision
    links: DataFrame        # (node, nb), both ways
    size: int               # nodes
    tables: tuple[str, ...]

    def drop(self) -> None:
        """Drop the tables; what was not stored yet cannot be computed any more."""
        for name in self.tables:
            self.members.sparkSession.sql(f"DROP TABLE IF EXISTS {name}")


def _by_node(df: DataFrame) -> str:
    """The name of a table of df in buckets of `node`, a file each."""
    spark, name = df.sparkSession, f"ann_{uuid.uuid4().hex}"
    buckets = shuffle_partitions(spark)
    df.repartition(buckets, "node").write.bucketBy(buckets, "node").saveAsTable(name)
    return name


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v): rows that take part, v as bytes of doubles."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vec_col).cast("array<double>").alias("x"))
    fine = F.size("x") > 0
    fine = fine & ~F.exists("x", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = rows.where(F.col("x").isNotNull() & fine & F.exists("x", lambda c: c != 0))
    length = rows.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    rows = rows.where(F.size("x") == (length["d"] if length else 0))
    schema = pa.schema([("id", arrow_type(rows, "id")), ("v", pa.binary())])

    def pack(batches: Batches) -> Batches:
        for b in batches:
            x = matrix(b.column(1)) + 0.0       # -0.0 is 0.0
            yield batch(schema, b.column(0), [r.tobytes() for r in x])

    return map_arrow(rows, pack, schema)


def matrix(lists: pa.Array) -> np.ndarray:
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def vectors_of(column: pa.Array, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), -1)


def _nodes(rows: DataFrame) -> str:
    """The table (node, v) of distinct vectors named by their smallest id."""
    return _by_node(rows.groupBy("v").agg(F.min("id").alias("node")).select("node", "v"))


# ---- first neighbours --------------------------------------------------------------

def _cut_tree(x: np.ndarray, smallest: int, rng: np.random.Generator) -> list[tuple]:
    """Inner nodes (direction, threshold, child below, child above); a child below 0 is leaf -1 - child."""
    tree: list = []
    leaves = 0

    def cut(at: np.ndarray, depth: int) -> int:
        nonlocal leaves
        if len(at) <= smallest or depth > 40:
            leaves += 1
            return -leaves
        a, b = rng.choice(at, 2, replace=False)
        direction = x[a] - x[b]
        place = x[at] @ direction
        middle = float(np.median(place))
        low, high = at[place < middle], at[place >= middle]
        if not len(low) or not len(high):
            leaves += 1
            return -leaves
        i = len(tree)
        tree.append(None)
        tree[i] = (direction, middle, cut(low, depth + 1), cut(high, depth + 1))
        return i

    root = cut(np.arange(len(x)), 0)
    return tree if root >= 0 else []


def _leaves(tree: list[tuple], x: np.ndarray) -> np.ndarray:
    at = np.zeros(len(x), np.int64)
    if not tree:
        return at
    open_nodes = [(0, np.arange(len(x)))]
    while open_nodes:
        i, rows = open_nodes.pop()
        direction, middle, low, high = tree[i]
        below = x[rows] @ direction < middle
        for child, some in ((low, rows[below]), (high, rows[~below])):
            if child < 0:
                at[some] = -1 - child
            elif len(some):
                open_nodes.append((child, some))
    return at


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of paired rows, as sums of squared differences."""
    d = x - y
    return np.einsum("...j,...j->...", d, d)


def _distances(x: np.ndarray) -> np.ndarray:
    """Squared distances of all rows to each other, a row at a time: no product of large components is subtracted."""
    d = np.stack([_squares(x, r) for r in x])
    np.fill_diagonal(d, np.inf)
    return d


_EDGES = pa.schema([("node", pa.int64()), ("nb", pa.int64()), ("d", pa.float64()), ("new", pa.int32())])


def _first_edges(nodes: DataFrame, n: int, k: int, trees: int) -> DataFrame:
    sample = nodes.where(F.pmod(F.xxhash64("node"), F.lit(1_000_000)) < max(1, min(1_000_000, 1_000_000 * SAMPLE // n)))
    x = np.array([np.frombuffer(r["v"], "<f8") for r in sample.select("v").collect()])
    rng = np.random.default_rng(11)
    smallest = max(8, LEAF * len(x) // n)
    forest = [_cut_tree(x, smallest, rng) for _ in range(trees)] if len(x) > 1 else [[]]
    schema = pa.schema([("node", pa.int64()), ("v", pa.binary()), ("tree", pa.int32()), ("leaf", pa.int64())])

    def descend(batches: Batches) -> Batches:
        for b in batches:
            if not b.num_rows:
                continue
            some = vectors_of(b.column(1), "<f8")
            for t, tree in enumerate(forest):
                yield batch(schema, b.column(0), b.column(1), np.full(len(some), t, np.int32), _leaves(tree, some))

    placed = map_arrow(nodes.select("node", "v"), descend, schema)
    sizes = placed.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    blocks = placed.join(sizes, ["tree", "leaf"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))

    def meet(t: pa.Table) -> pa.Table:
        ids = t.column("node").to_numpy()
        d = _distances(vectors_of(t.column("v"), "<f8"))
        m = min(k, len(ids) - 1)
        if m < 1:
            return _EDGES.empty_table()
        near = np.argpartition(d, m - 1, axis=1)[:, :m]
        return pa.table([np.repeat(ids, m), ids[near].ravel(), np.take_along_axis(d, near, 1).ravel(),
                         np.ones(near.size, np.int32)], schema=_EDGES)

    return blocks.groupBy("tree", "leaf", "block").applyInArrow(meet, "node long, nb long, d double, new int")


# ---- NN-descent --------------------------------------------------------------------

def _nearest(edges: DataFrame, k: int) -> DataFrame:
    """The k nearest distinct neighbours of each node; an edge known before is not new."""
    once = edges.groupBy("node", "nb").agg(F.min("d").alias("d"), F.min("new").alias("new"))
    rank = F.row_number().over(Window.partitionBy("node").orderBy("d", "nb"))
    return once.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def _local_join(graph: DataFrame, nodes: DataFrame, k: int, salt: int) -> DataFrame:
    """Improvements found among the neighbours of each node; `salt` deals many neighbours to other buckets."""
    radius = graph.groupBy("node").agg(F.when(F.count("*") >= k, F.max("d")).otherwise(float("inf")).alias("radius"))
    both = graph.select(F.col("node").alias("u"), F.col("nb").alias("node"), "new") \
        .unionAll(graph.select(F.col("nb").alias("u"), "node", "new")) \
        .groupBy("u", "node").agg(F.max("new").alias("new"))
    # Without a new edge a node has nothing new to tell its neighbours.
    buckets = both.groupBy("u").agg(F.ceil(F.count("*") / BUCKET).alias("buckets"), F.max("new").alias("any")) \
        .where(F.col("any") > 0).drop("any")
    seen = nodes.select("node", "v").join(radius, "node")
    rows = both.join(buckets, "u").join(seen, "node") \
        .withColumn("bucket", F.pmod(F.xxhash64("node", F.lit(salt)), F.col("buckets")))
    groups = rows.groupBy("u", "bucket").agg(F.collect_list(F.struct("node", "new", "radius", "v")).alias("g"))

    def join(batches: Batches) -> Batches:
        for b in batches:
            cols: list[list] = [[], [], []]
            ends = b.column(0).offsets.to_numpy()
            flat = b.column(0).flatten()            # of this batch only
            ids, new, radii, v = (flat.field(i) for i in range(4))
            ids, new = ids.to_numpy(), new.to_numpy() > 0
            radii, x = radii.to_numpy(), vectors_of(v, "<f8")
            ends = ends - ends[0]
            for a, z in zip(ends[:-1], ends[1:], strict=True):
                if z - a < 2 or not new[a:z].any():
                    continue
                d = _distances(x[a:z])
                hit = (d < radii[a:z, None]) & (new[a:z, None] | new[None, a:z])
                i, j = np.nonzero(hit)
                cols[0].append(ids[a:z][i])
                cols[1].append(ids[a:z][j])
                cols[2].append(d[i, j])
            if cols[0]:
                got = [np.concatenate(c) for c in cols]
                yield batch(_EDGES, *got, np.ones(len(got[0]), np.int32))

    return map_arrow(groups.select("g"), join, _EDGES)


def build(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = NEIGHBOURS,
          trees: int = TREES, rounds: int = ROUNDS) -> Index:
    """Index every usable row; `drop()` the index when it is not needed any more."""
    rows = stored(usable(vectors, id_col, vec_col))
    table = _nodes(rows)
    nodes = rows.sparkSession.table(table)
    n = nodes.count()
    members = rows.join(nodes.select("node", "v"), "v").select("node", "id")
    graph = stored(_nearest(_first_edges(nodes, max(n, 1), k, grown(trees, n)), k))
    for r in range(rounds):
        known = graph.withColumn("new", F.lit(0))
        graph = stored(_nearest(known.unionByName(_local_join(graph, nodes, k, r)), k))
        if graph.agg(F.coalesce(F.sum("new"), F.lit(0))).first()[0] <= CHANGED * k * n:
            break
    there = graph.select("node", "nb")
    links = _by_node(there.unionAll(there.select(F.col("nb").alias("node"), F.col("node").alias("nb"))))
    return Index(members, nodes, rows.sparkSession.table(links), n, (table, links))


# ---- search ------------------------------------------------------------------------

def search(index: Index, queries: DataFrame, k: int = 10, beam: int = BEAM, opened: int = OPENED) -> DataFrame:
    """queries (query_id, v) -> (query_id, node, d): the beam of each query at the end."""
    beam = grown(beam, index.size)
    pivots = index.nodes.orderBy(F.xxhash64("node")).limit(grown(PIVOTS, index.size)).select("node", "v").collect()
    if not pivots:
        return queries.sparkSession.createDataFrame([], "query_id long, node long, d double")
    names = np.array([p["node"] for p in pivots])
    places = np.array([np.frombuffer(p["v"], "<f8") for p in pivots])
    start_schema = pa.schema([("query_id", pa.int64()), ("node", pa.int64())])

    def starts(batches: Batches) -> Batches:
        for b in batches:
            if b.num_rows:
                x = vectors_of(b.column(1), "<f8")
                m = min(4, len(names))
                near = np.array([np.argsort(((places - q) ** 2).sum(1), kind="stable")[:m] for q in x])
                yield batch(start_schema, np.repeat(b.column(0).to_numpy(), m), names[near].ravel())

    near_schema = pa.schema([("query_id", pa.int64()), ("node", pa.int64()), ("d", pa.float64())])

    def measure(batches: Batches) -> Batches:
        for b in batches:
            if b.num_rows:
                x, y = (vectors_of(b.column(i), "<f8") for i in (2, 3))
                yield batch(near_schema, b.column(0), b.column(1), np.sqrt(_squares(x, y)))

    def measured(pairs: DataFrame) -> DataFrame:
        rows = pairs.join(index.nodes.select("node", F.col("v").alias("x")), "node").join(
            asked.select("query_id", F.col("v").alias("y")), "query_id")
        return map_arrow(rows.select("query_id", "node", "x", "y"), measure, near_schema).withColumn("done", F.lit(0))

    asked = stored(queries.select("query_id", "v"))
    own = queries.join(index.nodes.select("node", "v"), "v").select("query_id", "node")
    first = own.unionByName(map_arrow(queries.select("query_id", "v"), starts, start_schema)).distinct()
    by_distance = Window.partitionBy("query_id").orderBy("d", "node")
    state = stored(measured(first))
    for _ in range(math.ceil(4 * beam / opened)):
        unopened = state.where("done = 0").withColumn("_r", F.row_number().over(by_distance)) \
            .where(F.col("_r") <= opened).select("query_id", "node")
        marked = state.join(unopened.withColumn("_o", F.lit(1)), ["query_id", "node"], "left") \
            .select("query_id", "node", "d", F.greatest("done", F.coalesce("_o", F.lit(0))).alias("done"))
        found = unopened.join(index.links, "node").select("query_id", F.col("nb").alias("node")).distinct() \
            .join(state.select("query_id", "node"), ["query_id", "node"], "left_anti")
        merged = marked.unionByName(measured(found))
        state = stored(merged.withColumn("_r", F.row_number().over(by_distance)).where(F.col("_r") <= beam).drop("_r"))
        if state.where("done = 0").limit(1).count() == 0:
            break
    return state.select("query_id", "node", "d")


def neighbours(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding",
               k: int = 10, **how) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest other rows found for each row of `queries`."""
    index = build(vectors, id_col, vec_col)
    try:
        return stored(_ranked(index, queries, id_col, vec_col, k, how))
    finally:
        index.drop()


def _ranked(index: Index, queries: DataFrame, id_col: str, vec_col: str, k: int, how: dict) -> DataFrame:
    asked = stored(usable_like(queries, index, id_col, vec_col))
    beam = search(index, asked, k, **how)
    # Of equal vectors only the k + 1 smallest ids can be among the k nearest others.
    smallest = Window.partitionBy("node").orderBy("id")
    few = index.members.withColumn("_r", F.row_number().over(smallest)).where(F.col("_r") <= k + 1).drop("_r")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return beam.join(few, "node").where("id <> query_id") \
        .select("query_id", F.col("id").alias("vec_id"), F.col("d").alias("score")) \
        .withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def usable_like(queries: DataFrame, index: Index, id_col: str, vec_col: str) -> DataFrame:
    """(query_id, v): the queries that can be compared with the index."""
    row = index.nodes.select(F.octet_length("v").alias("n")).first()
    rows = usable(queries, id_col, vec_col)
    return rows.where(F.octet_length("v") == (row["n"] if row else 0)).select(F.col("id").alias("query_id"), "v")
