"""Benchmark decontamination by greedy string tiling with running Karp-Rabin matching.

1. Seeds: hashes of all `seed`-word windows of the benchmark items and of each
   document; a document and an item that share one are a candidate pair.
2. Tiles: for a search length that falls from the item's length to `seed`, windows
   of words not yet in a tile are hashed, equal windows are verified and extended,
   and the longest matches are marked, none overlapping another. A match much
   longer than the search length restarts the search there.
3. The covered share of the item's words is the pair's coverage, whatever the
   order of the tiles in the document; from `threshold` on it is contaminated.

Benchmark items are cut into blocks of at most `block_words` words. A block is
broadcast, its size being bounded so, and all documents pass each block.

Words are runs of letters and digits in lower case. Rows: null, empty and wordless
texts are clean; items with fewer than `seed` words have no seed and match
nothing. Of equal coverages the smaller item id counts. Repeated rows get a result
each; other columns are not read. Without items all documents are clean.
"""

from __future__ import annotations

import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm.common import Batches, arrow_type, batch, map_arrow, stored, text_or_empty

SEED = 5
THRESHOLD = 0.5
BLOCK_WORDS = 1 << 20
_WORD = re.compile(r"[^\W_]+")
_BASE = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def windows(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes, modulo 2^64, of all windows of n values."""
    if len(ids) < n:
        return np.zeros(0, np.uint64)
    size = len(ids) - n + 1
    out, power, done, run = np.zeros(size, np.uint64), _BASE, 0, (ids.astype(np.uint64) + np.uint64(1)) * _BASE
    # Windows of 1, 2, 4, ... values; those in the binary form of n make up n.
    step = 1
    while True:
        if n & step:
            out = out * power + run[done:done + size]
            done += step
        if done == n:
            return out
        run = run[:len(run) - step] * power + run[step:]
        power = np.uint64(int(power) ** 2 & (1 << 64) - 1)
        step *= 2


class Items:
    """A block of benchmark items as word numbers, with the seeds of all of them."""

    def __init__(self, items: list[tuple], seed: int):
        self.seed, self.numbers = seed, {}
        self.keys, self.ids = [], []
        for key, text in items:
            self.keys.append(key)
            self.ids.append(np.array([self.numbers.setdefault(w, len(self.numbers)) for w in words_of(text)], np.int64))
        hashes = [windows(i, seed) for i in self.ids]
        owners = np.repeat(np.arange(len(items)), [len(h) for h in hashes])
        found = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(found, kind="stable")
        self.hashes, self.owners = found[order], owners[order]

    def candidates(self, doc: np.ndarray) -> np.ndarray:
        """Items that share a seed with the document."""
        seeds = windows(doc, self.seed)
        if not len(self.hashes) or not len(seeds):
            return np.zeros(0, np.int64)
        # Windows with a word that no item has can't match; the rest are looked up.
        known = np.concatenate([[0], np.cumsum(doc < 0)])
        seeds = np.unique(seeds[known[self.seed:] == known[:-self.seed]])
        low, high = np.searchsorted(self.hashes, seeds, "left"), np.searchsorted(self.hashes, seeds, "right")
        hit = high > low
        return np.unique(np.concatenate([self.owners[a:b] for a, b in zip(low[hit], high[hit], strict=True)]
                                        or [np.zeros(0, np.int64)]))


def _matches(item: np.ndarray, doc: np.ndarray, free_i: np.ndarray, free_d: np.ndarray, n: int):
    """Maximal matches (length, item start, doc start) of at least n free words."""
    whole_i = windows(item, n)
    whole_d = windows(doc, n)
    at_i = np.flatnonzero(windows_free(free_i, n))
    at_d = np.flatnonzero(windows_free(free_d, n))
    places = defaultdict(list)
    for i in at_i:
        places[whole_i[i]].append(int(i))
    at_d = at_d[np.isin(whole_d[at_d], whole_i[at_i])]
    out, seen = [], set()
    for d in map(int, at_d):
        for i in places[whole_d[d]]:
            if (i - 1, d - 1) in seen:          # inside a match that began a word earlier
                seen.add((i, d))
                continue
            if not np.array_equal(item[i:i + n], doc[d:d + n]):
                continue
            seen.add((i, d))
            k = n
            while i + k < len(item) and d + k < len(doc) and item[i + k] == doc[d + k] \
                    and free_i[i + k] and free_d[d + k]:
                k += 1
            out.append((k, i, d))
    return out


def windows_free(free: np.ndarray, n: int) -> np.ndarray:
    """Whether each window of n words is free of tiles."""
    if len(free) < n:
        return np.zeros(0, bool)
    total = np.concatenate([[0], np.cumsum(free)])
    return total[n:] - total[:-n] == n


def tiles(item: np.ndarray, doc: np.ndarray, seed: int = SEED) -> list[tuple[int, int, int]]:
    """Greedy tiles (length, item start, doc start) of the item in the document."""
    free_i, free_d = np.ones(len(item), bool), doc >= 0
    out, n = [], max(seed, len(item))
    while len(item) >= seed:
        found = sorted(_matches(item, doc, free_i, free_d, n), key=lambda m: (-m[0], m[1], m[2]))
        if found and found[0][0] > 2 * n:
            n = found[0][0]                     # restart at the long match
            continue
        for k, i, d in found:
            if free_i[i:i + k].all() and free_d[d:d + k].all():
                free_i[i:i + k] = free_d[d:d + k] = False
                out.append((k, i, d))
        if n == seed:
            # Matches cut by longer ones may have left pieces of seed length or more.
            if not found:
                break
        else:
            n = max(seed, n // 2)
    return out


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_words: int) -> list[list[tuple]]:
    """Items in blocks of at most block_words words (a longer item alone), read one block at a time."""
    n_words = F.size(F.split(text_or_empty(text_col), r"\s+"))
    total = benchmark.agg(F.coalesce(F.sum(n_words), F.lit(0))).first()[0]
    parts = 1 + 2 * int(total) // block_words
    rows = benchmark.select(item_col, text_or_empty(text_col).alias("_t"))
    part = F.pmod(F.xxhash64(F.col(item_col), F.col("_t")), F.lit(parts))
    for p in range(parts):
        block, size = [], 0
        for key, text in rows.where(part == p).orderBy(item_col, "_t").toLocalIterator():
            n = 1 + text.count(" ")
            if block and size + n > block_words:
                yield block
                block, size = [], 0
            block.append((key, text))
            size += n
        if block:
            yield block


def coverages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              item_col: str = "item_id", item_text: str = "text", seed: int = SEED,
              block_words: int = BLOCK_WORDS) -> DataFrame:
    """(id, _h, item_id, coverage, n_tiles) of every pair that shares a seed; _h tells texts of one id apart."""
    schema = pa.schema([(id_col, arrow_type(docs, id_col)), ("_h", pa.int64()),
                        ("item_id", arrow_type(benchmark, item_col)), ("coverage", pa.float64()),
                        ("n_tiles", pa.int32()), ("longest", pa.int32())])
    text = text_or_empty(text_col)
    rows = docs.select(id_col, F.xxhash64(text).alias("_h"), text.alias("_t"))
    out = None
    for block in _blocks(benchmark, item_col, item_text, block_words):
        shared = docs.sparkSession.sparkContext.broadcast(block)

        def run(batches: Batches, shared=shared) -> Batches:
            items = Items(shared.value, seed)
            number = items.numbers.get
            for b in batches:
                found = []
                for key, h, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    words = words_of(t)
                    doc = np.array([number(w, -1) for w in words], np.int64)
                    for i in items.candidates(doc):
                        got = tiles(items.ids[i], doc, seed)
                        if got:
                            found.append((key, h, items.keys[i], sum(g[0] for g in got) / len(items.ids[i]),
                                          len(got), max(g[0] for g in got)))
                if found:
                    yield batch(schema, *zip(*found, strict=True))

        part = map_arrow(rows, run, schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else map_arrow(rows.limit(0), lambda batches: iter(()), schema)


def contamination(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
                  text_col: str = "text", **how) -> DataFrame:
    """(id, contaminated, item_id, coverage, n_tiles, n_items) of every row.

    item_id is the item with the largest coverage, n_items the number of items at
    the threshold or above.
    """
    pairs = coverages(docs, benchmark, id_col, text_col, **how)
    best = F.max_by(F.struct("item_id", "coverage", "n_tiles"), F.struct("coverage", -F.col("item_id")))
    # Repeated rows find each pair again; a document has few pairs, so distinct ones are enough.
    per = stored(pairs.distinct().groupBy(F.col(id_col).alias("_id"), F.col("_h").alias("_g")).agg(
        best.alias("_b"), F.count_if(F.col("coverage") >= threshold).alias("_n")))
    rows = docs.select(id_col, F.xxhash64(text_or_empty(text_col)).alias("_h"))
    joined = rows.join(per, F.col(id_col).eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_g")), "left")
    coverage = F.coalesce("_b.coverage", F.lit(0.0))
    return joined.select(
        id_col, (coverage >= threshold).alias("contaminated"), F.col("_b.item_id").alias("item_id"),
        coverage.alias("coverage"), F.coalesce("_b.n_tiles", F.lit(0)).alias("n_tiles"),
        F.coalesce("_n", F.lit(0)).alias("n_items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id",
                  text_col: str = "text", **how) -> DataFrame:
    """docs without the contaminated rows."""
    hit = stored(coverages(docs, benchmark, id_col, text_col, **how).where(F.col("coverage") >= threshold)
                 .select(F.col(id_col).alias("_id"), F.col("_h").alias("_g")).distinct())
    same = docs[id_col].eqNullSafe(hit["_id"]) & (F.xxhash64(text_or_empty(text_col)) == hit["_g"])
    return docs.join(hit, same, "left_anti")
