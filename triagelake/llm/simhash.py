"""SimHash near-duplicates: meet-in-the-middle ball hashing.

Two fingerprints within `max_bits` of each other have a common variant that is
within half of that of both. Every distinct fingerprint emits all its variants
within that half radius (65 for 2 bits), the variants are shuffled, and
fingerprints that meet in a variant are linked once their distance is verified.

Rows: a null or blank text has fingerprint 0 and is linked like any other. Equal
texts and repeated rows share a fingerprint and a component. The component id is
the smallest non-null id reachable (null if all ids of the component are null).
Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triagelake.llm.common import Batches, arrow_type, batch, fresh, map_arrow, stored, text_bytes, text_or_empty
from triagelake.llm.components import components

SEED = 42
SHINGLE = 3
MAX_BITS = 2
_CHUNK = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 of the word shingles, repeats counted, as an unsigned integer."""
    words = text.lower().split()            # bytes: lower-cases A-Z, splits at ASCII white space
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    n = len(words) - shingle + 1
    shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), "<u8", n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, _CHUNK):
        bits = np.unpackbits(hashes[i:i + _CHUNK].view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 shingle: int = SHINGLE) -> DataFrame:
    """(id, _h, fp): the fingerprint of every row as a signed long with the same bits; _h is a hash of the text."""
    schema = pa.schema([(id_col, arrow_type(docs, id_col)), ("_h", pa.int64()), ("fp", pa.int64())])

    def run(batches: Batches) -> Batches:
        for b in batches:
            fps = [fingerprint(t, shingle) for t in b.column(2).to_pylist()]
            yield batch(schema, b.column(0), b.column(1), pa.array(np.array(fps, "<u8").view("<i8")))

    return map_arrow(docs.select(id_col, F.xxhash64(text_or_empty(text_col)).alias("_h"),
                                 text_bytes(text_col).alias("_t")), run, schema)


def _masks(bits: int) -> list[int]:
    masks = [0]
    for r in range(1, bits + 1):
        masks += [sum(1 << b for b in c) for c in combinations(range(64), r)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """fps (fp), distinct -> (a, b): links that connect all fingerprints within max_bits.

    All members of a variant's bucket lie within half the radius of the variant,
    so a bucket has at most as many members as there are masks, and for an even
    radius neighbours in sorted order connect it. For an odd radius each member is
    compared with all earlier ones of its bucket.
    """
    masks = F.array(*[F.lit(m).cast("long") for m in _masks((max_bits + 1) // 2)])
    near = fps.select("fp", F.explode(F.transform(masks, lambda m: F.col("fp").bitwiseXOR(m))).alias("v"))
    by_variant = Window.partitionBy("v").orderBy("fp")
    if max_bits % 2 == 0:
        pairs = near.select("fp", F.lag("fp").over(by_variant).alias("b")).where("b is not null")
    else:
        earlier = F.collect_list("fp").over(by_variant.rowsBetween(Window.unboundedPreceding, -1))
        pairs = near.select("fp", earlier.alias("e")).select("fp", F.explode("e").alias("b"))
    return (pairs.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= max_bits)
            .select(F.col("fp").alias("a"), "b").distinct())


def _named(rows: DataFrame, id_col: str, max_bits: int) -> DataFrame:
    """(fp, _root, component_id) of every distinct fingerprint."""
    classes = stored(rows.groupBy("fp").agg(F.min(id_col).alias("_first")))
    tree = components(links(classes.select("fp"), max_bits))
    rooted = classes.join(tree.select(F.col("a").alias("fp"), F.col("b").alias("_root")), "fp", "left") \
        .select("fp", "_first", F.coalesce("_root", "fp").alias("_root"))
    least = rooted.groupBy("_root").agg(F.min("_first").alias("component_id"))
    return rooted.join(least, "_root").select("fp", "_root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """(id, fingerprint, component_id) of every row."""
    rows = stored(fingerprints(docs, id_col, text_col, shingle))
    return rows.join(_named(rows, id_col, max_bits), "fp").select(
        id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             max_bits: int = MAX_BITS) -> DataFrame:
    """docs with one row of each group of near-duplicates: that of the smallest id (null ids last)."""
    rows = stored(fingerprints(docs, id_col, text_col, shingle))
    key, own = fresh(docs, "_id", "_g")
    winner = F.min(F.struct(F.col(id_col).isNull().alias("_n"), F.col(id_col).alias(key), F.col("_h").alias(own)))
    best = rows.join(_named(rows, id_col, max_bits), "fp").groupBy("_root").agg(winner.alias("_w"))
    best = stored(best.select(f"_w.{key}", f"_w.{own}").distinct())
    same = docs[id_col].eqNullSafe(best[key]) & (F.xxhash64(text_or_empty(text_col)) == best[own])
    kept = docs.join(best, same)
    return kept.dropDuplicates([key, own]).select(*[docs[c] for c in docs.columns])
