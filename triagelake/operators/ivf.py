"""Approximate vector search: an inverted file of cells, stored as a table.

Building puts every vector into the cell of its nearest centre (k-means on a
bounded sample) and writes vectors and centres as Parquet. A search sends each probe to
the `visits` cells whose centres are nearest, never to more, and multiplies
probes and cells in bounded parts. With as many visits as cells it is exact. The
exact search stays in `blocks.py`.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.operators import blocks
from triagelake.operators.keyed import top_per_key

CELL_ROWS = 2048            # rows of a cell on average, as long as MAX_CELLS is not reached
MAX_CELLS = 16_384          # centres are broadcast: at most this many
SAMPLE = 200_000            # rows k-means sees, about
ITERATIONS = 8


@dataclass
class IvfIndex:
    """Vectors (grp, cid, u, cell) under path/vectors and centres (cell, u) under path/centres."""

    spark: SparkSession
    path: str

    @property
    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/vectors")

    def centres(self) -> np.ndarray:
        """One row per cell, in order; MAX_CELLS rows at most."""
        rows = self.spark.read.parquet(f"{self.path}/centres").orderBy("cell").collect()
        return np.array([r["u"] for r in rows], np.float64)

    def append(self, vectors: DataFrame) -> None:
        """Adds (grp, cid, u) to the cells there are."""
        placed = _nearest(vectors.select("grp", "cid", "u"), self.centres(), 1)
        # Rows of a cell lie together; a large one spans several files.
        placed.repartitionByRange("cell", F.xxhash64("cid")).write.mode("append").parquet(f"{self.path}/vectors")


def build(vectors: DataFrame, path: str, cells: int | None = None, sample: int = SAMPLE, seed: int = 7) -> IvfIndex:
    """Index of (grp, cid, u), unit vectors. `cells` defaults to rows / CELL_ROWS, at most MAX_CELLS.

    The sample takes rows by a hash of their id, so it is the same on every run."""
    spark, n = vectors.sparkSession, vectors.count()
    cells = min(MAX_CELLS, cells or max(1, math.ceil(n / CELL_ROWS)))
    some = vectors.where(F.pmod(F.xxhash64("cid"), F.lit(max(n, 1))) < sample).select(array_to_vector("u").alias("features"))
    found: list[list[float]] = []
    if n and cells > 1:
        model = KMeans(k=cells, seed=seed, maxIter=ITERATIONS, initMode="random").fit(some.repartition(8))
        found = [c.tolist() for c in model.clusterCenters()]
    elif n:
        found = [vectors.select("u").first()[0]]
    spark.createDataFrame(list(enumerate(found)), "cell int, u array<double>").write.parquet(f"{path}/centres")
    index = IvfIndex(spark, path)
    index.append(vectors)
    return index


def default_visits(cells: int) -> int:
    """Cells a probe visits: all of a few, twice the square root of many."""
    return min(cells, max(8, 2 * math.isqrt(cells)))


def _nearest(df: DataFrame, centres: np.ndarray, visits: int) -> DataFrame:
    """df repeated for the `visits` nearest centres of `u`, with their `cell`."""
    schema = df.withColumn("cell", F.lit(None).cast("int")).schema
    half = (centres ** 2).sum(axis=1) / 2 if len(centres) else None

    def run(batches):
        for b in batches:
            if b.num_rows == 0 or half is None:
                continue
            t = pa.Table.from_batches([b])
            far = half - blocks.matrix(t["u"]) @ centres.T
            cell = np.argpartition(far, visits - 1, axis=1)[:, :visits] if visits < far.shape[1] else np.tile(
                np.arange(far.shape[1]), (len(far), 1))
            t = t.take(pa.array(np.repeat(np.arange(len(far)), cell.shape[1])))
            yield from t.append_column("cell", pa.array(cell.ravel().astype(np.int32))).to_batches()

    return df.mapInArrow(run, schema)


def visited(index: IvfIndex, probes: DataFrame, visits: int | None = None) -> DataFrame:
    """Probes (grp, pid, u), each once for every cell it visits."""
    centres = index.centres()
    return _nearest(probes.select("grp", "pid", "u"), centres, min(visits or default_visits(len(centres)), max(1, len(centres))))


def search(index: IvfIndex, probes: DataFrame, k: int, min_score: float, visits: int | None = None,
           exclude_self: bool = False, block: int = blocks.BLOCK) -> DataFrame:
    """(grp, pid, cid, score, rank): the best k of the visited cells per probe, of its group; ties by id."""
    kinds, corpus = dict(probes.dtypes), index.vectors
    cid = dict(corpus.dtypes)["cid"]
    arrow = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}
    schema = pa.schema([("grp", arrow[kinds["grp"]]), ("pid", arrow[kinds["pid"]]), ("cid", arrow[cid]), ("score", pa.float64())])
    left = visited(index, probes, visits)
    keys = ["grp", "cell"]

    tile = blocks.tile_rows(corpus.agg(F.max(F.size("u"))).first()[0], block)

    def parts(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(blocks.part_count(F.count("*"), block, tile).alias(name))

    # A few numbers for every cell and group that both sides have.
    need = parts(left, "parts").join(parts(corpus, "subs"), keys)

    def dealt(df: DataFrame, own: str, its: str, other: str, copies: str) -> DataFrame:
        return df.join(need, keys).withColumn(its, F.pmod(F.xxhash64(own), F.col("parts" if its == "part" else "subs")).cast("int")) \
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(copies) - 1))).drop("parts", "subs")

    place = [*keys, "sub", "part"]
    p = dealt(left, "pid", "part", "sub", "subs")
    c = dealt(corpus, "cid", "sub", "part", "parts")
    c = c.select(*[F.col(x).alias(x) for x in c.columns])
    best = p.groupBy(*place).cogroup(c.groupBy(*place)).applyInArrow(
        blocks.topk_kernel(k, min_score, exclude_self, schema),
        f"grp {kinds['grp']}, pid {kinds['pid']}, cid {cid}, score double")
    return top_per_key(best, ["grp", "pid"], [F.col("score").desc(), F.col("cid")], k)
