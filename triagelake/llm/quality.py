"""Quality scores by Bradley-Terry pairwise ranking.

Every document gets a vector of surface features. In a preference pair a good
document beats a bad one with probability 1 / (1 + exp(-w (x_good - x_bad))); w
minimises the logistic loss over pairs of the labelled rows. The utility
w x is cut at the quantile of the labelled utilities that matches the share of bad
labels, and the score is 1 / (1 + exp(-(w x - cut + log(p / (1 - p))))), which is p
(CUT_SCORE) at the cut.

The fit sees every labelled row (equal rows of an id count once): they are dealt to
buckets by a hash, and in its bucket each is paired with PARTNERS of the other kind.
Mean, spread, each Newton step and the cut are taken over all of them by Spark; the
driver gets sums. A caller may ask for a fit on a sample of bounded size instead.

Rows: a null or empty text has the feature vector of an empty text and gets a
score. Repeated rows are scored each; labels of an id that disagree count as good.
Without labels of both kinds every score is the share of good labels (0.5 without
any). Other columns are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm.common import Batches, arrow_type, batch, map_arrow, stored, text_or_empty

PAIRS = 50_000                # of a fit on a sample
BUCKET, PARTNERS, LEAST = 2048, 4, 16   # rows of a bucket, pairs of a row, rows of the rarer kind in a bucket, about
STEPS = 15
BINS = 4096
CUT_SCORE = 0.3
RIDGE = 1e-2

_MARKS = [b for b in range(33, 127) if not chr(b).isalnum()]


def features(text: str) -> list[float]:
    """Shares of characters, words and lines of a kind; logarithms of sizes."""
    raw = np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256)
    n = max(1, int(raw.sum()))
    words, lines = text.split(), text.split("\n")
    w = max(1, len(words))
    letters = max(1, int(raw[65:91].sum() + raw[97:123].sum() + raw[128:].sum()))
    marks = raw[_MARKS]
    distinct = Counter(words)
    top = max(distinct.values(), default=0)
    line_chars = Counter()
    for line in lines:
        line_chars[line] += 1
    again = sum(len(line) * (k - 1) for line, k in line_chars.items())
    return [
        np.log1p(n), np.log1p(len(words)), np.log1p(len(lines)),
        raw[65:91].sum() / letters, raw[48:58].sum() / n, raw[128:].sum() / n, raw[10] / n, raw[32] / n,
        marks.sum() / n, marks.sum() / w, *(np.sqrt(marks / w)),
        (n - raw[32] - raw[10]) / w, len(distinct) / w, len(distinct) / np.sqrt(w), top / w,
        sum(map(eq, words, words[1:])) / w, len(line_chars) / len(lines), again / n,
        sum(map(str.isupper, words)) / w, sum(map(str.isalpha, words)) / w, sum(map(str.istitle, words)) / w,
    ]


WIDTH = len(features(""))


@dataclass
class Ranking:
    """Standardised linear utility and its cut."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    prior: float | None = None          # the score of every text where nothing was learned

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.prior is not None:
            return np.full(len(x), self.prior)
        margin = self.utilities(x) - self.cut + np.log(CUT_SCORE / (1 - CUT_SCORE))
        return 1.0 / (1.0 + np.exp(-np.clip(margin, -500, 500)))

    def utilities(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights


def feature_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, x): the feature vector of every row."""
    schema = pa.schema([(id_col, arrow_type(docs, id_col)), ("x", pa.list_(pa.float32()))])

    def run(batches: Batches) -> Batches:
        for b in batches:
            x = np.array([features(t) for t in b.column(1).to_pylist()], np.float32).reshape(-1, WIDTH)
            offsets = pa.array(np.arange(0, x.size + 1, WIDTH, dtype=np.int32))
            yield batch(schema, b.column(0), pa.ListArray.from_arrays(offsets, pa.array(x.ravel())))

    return map_arrow(docs.select(id_col, text_or_empty(text_col).alias("_t")), run, schema)


def rank(x: np.ndarray, good: np.ndarray, pairs: int = PAIRS, ridge: float = RIDGE, seed: int = 7) -> Ranking:
    """Fit the utility on labelled vectors: Newton steps on the pairwise logistic loss."""
    if good.all() or not good.any():
        share = float(good.mean()) if len(good) else 0.5
        return Ranking(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0, share)
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.clip((x - mean) / scale, -8, 8)
    rng = np.random.default_rng(seed)
    winners = rng.choice(np.flatnonzero(good), pairs)
    losers = rng.choice(np.flatnonzero(~good), pairs)
    w = np.zeros(x.shape[1])
    for _ in range(15):
        gradient, hessian = ridge * w, ridge * np.eye(len(w))
        for i in range(0, pairs, 20_000):
            d = z[winners[i:i + 20_000]] - z[losers[i:i + 20_000]]
            p = 1.0 / (1.0 + np.exp(np.clip(d @ w, -500, 500)))     # that the loser is preferred
            gradient = gradient - d.T @ p / pairs
            hessian = hessian + (d * (p * (1 - p))[:, None]).T @ d / pairs
        step = np.linalg.solve(hessian, gradient)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    u = np.sort(z @ w)
    k = int((~good).sum())
    return Ranking(mean, scale, w, float((u[k - 1] + u[k]) / 2))


def _sums(table: DataFrame, fn, width: int) -> np.ndarray:
    """The sum of fn(batch), an array of `width` numbers, over all rows; a row per task goes to the driver."""
    schema = pa.schema([("s", pa.list_(pa.float64()))])

    def run(batches: Batches) -> Batches:
        total = np.zeros(width)
        for b in batches:
            if b.num_rows:
                total += fn(b)
        yield batch(schema, [total])

    # In one order, so that the sums do not depend on that of the tasks.
    return np.array(sorted(r["s"] for r in map_arrow(table, run, schema).collect())).reshape(-1, width).sum(0)


def _rows(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, WIDTH)


def _dealt(known: DataFrame, good: int, bad: int) -> DataFrame:
    """(good, bad): the vectors of each bucket by kind, as bytes of floats.

    A kind that is too rare for all buckets has its rows in several of them.
    """
    buckets = -(-(good + bad) // BUCKET)
    copies = {kind: max(1, -(-LEAST * buckets // n)) for kind, n in ((1, good), (0, bad))}
    times = F.when(F.col("_good") > 0, copies[1]).otherwise(copies[0])
    place = F.pmod(F.xxhash64("_h", "_t"), F.lit(buckets)).cast("int")
    rows = known.withColumn("_t", F.explode(F.sequence(F.lit(1), times))).select(place.alias("_b"), "_good", "_h", "x")
    schema = pa.schema([("good", pa.binary()), ("bad", pa.binary())])

    def pack(t: pa.Table) -> pa.Table:
        t = t.sort_by("_h").combine_chunks()
        x, good = _rows(pa.concat_arrays(t["x"].chunks)).astype("<f4"), t["_good"].to_numpy() > 0
        return pa.table([[x[good].tobytes()], [x[~good].tobytes()]], schema=schema)

    return rows.groupBy("_b").applyInArrow(pack, "good binary, bad binary")


def _differences(good: bytes, bad: bytes, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised good less bad vectors of the pairs of a bucket."""
    g, b = (np.clip((np.frombuffer(v, "<f4").reshape(-1, WIDTH) - mean) / scale, -8, 8) for v in (good, bad))
    if not len(g) or not len(b):
        return np.zeros((0, WIDTH))
    i = np.arange(max(len(g), len(b)))
    return np.concatenate([g[i % len(g)] - b[(i + t) % len(b)] for t in range(PARTNERS)])


def _at_rank(values: DataFrame, k: int) -> float:
    """The mean of the k-th and the next of all `u`, by narrower and narrower histograms."""
    low, high = values.agg(F.min("u"), F.max("u")).first()
    left = k - 1
    while high > low and (high - low) / BINS > 0:
        place = F.floor((F.col("u") - low) / ((high - low) / BINS))
        bins = values.where(F.col("u").between(low, high)).groupBy(place.alias("at")).agg(
            F.count("*").alias("n"), F.min("u").alias("low"), F.max("u").alias("high")).orderBy("at").collect()
        i = 0
        while left >= bins[i]["n"]:
            left -= bins[i]["n"]
            i += 1
        if left == bins[i]["n"] - 1:
            return (bins[i]["high"] + bins[i + 1]["low"]) / 2
        low, high = bins[i]["low"], bins[i]["high"]
    return (low + high) / 2


def rank_all(known: DataFrame, ridge: float = RIDGE) -> Ranking:
    """The utility fitted on every row of (_good, _h, x): Newton steps on the pairwise logistic loss."""
    def counted(b: pa.RecordBatch) -> np.ndarray:
        good = b.column(0).to_numpy() > 0
        return np.concatenate([[good.sum(), (~good).sum()], _rows(b.column(1)).sum(0)])

    good, bad, *total = _sums(known.select("_good", "x"), counted, 2 + WIDTH)
    if not good or not bad:
        share = float(good / (good + bad)) if good + bad else 0.5
        return Ranking(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0, share)
    mean = np.array(total) / (good + bad)
    spread = _sums(known.select("x"), lambda b: ((_rows(b.column(0)) - mean) ** 2).sum(0), WIDTH)
    scale = np.sqrt(spread / (good + bad)) + 1e-6
    packed = stored(_dealt(known, int(good), int(bad)))
    w = np.zeros(WIDTH)
    for _ in range(STEPS):
        def part(b: pa.RecordBatch, w: np.ndarray = w) -> np.ndarray:
            out = np.zeros(1 + WIDTH + WIDTH * WIDTH)
            for g, l in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                d = _differences(g, l, mean, scale)
                p = 1.0 / (1.0 + np.exp(np.clip(d @ w, -500, 500)))     # that the loser is preferred
                out += np.concatenate([[len(d)], d.T @ p, ((d * (p * (1 - p))[:, None]).T @ d).ravel()])
            return out

        pairs, *sums = _sums(packed, part, 1 + WIDTH + WIDTH * WIDTH)
        sums = np.array(sums) / max(pairs, 1)
        step = np.linalg.solve(ridge * np.eye(WIDTH) + sums[WIDTH:].reshape(WIDTH, WIDTH), ridge * w - sums[:WIDTH])
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    found = Ranking(mean, scale, w, 0.0)
    schema = pa.schema([("u", pa.float64())])

    def utilities(batches: Batches) -> Batches:
        for b in batches:
            yield batch(schema, found.utilities(_rows(b.column(0))))

    found.cut = _at_rank(stored(map_arrow(known.select("x"), utilities, schema)), int(bad))
    return found


def fit(table: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality",
        sample_rows: int | None = None, pairs: int = PAIRS) -> Ranking:
    """Fit on all labelled rows of a feature table; with `sample_rows` on a sample of about so many, by `pairs` drawn pairs."""
    labels = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()) \
        .groupBy(id_col).agg(F.max(label_col).alias("_good"))
    known = table.join(labels, id_col).select("_good", "x", F.xxhash64(id_col, "x").alias("_h"))
    if sample_rows is None:
        return rank_all(stored(known.dropDuplicates(["_h"])))
    n = known.count()
    if n > sample_rows:
        known = known.where(F.pmod(F.col("_h"), F.lit(1_000_000)) < 1_000_000 * sample_rows // n)
    # In one order, so that the pairs drawn do not depend on that of the tasks.
    rows = sorted(known.dropDuplicates(["_h"]).collect(), key=lambda r: (r["_good"], r["x"]))
    x = np.array([r["x"] for r in rows], np.float64).reshape(-1, WIDTH)
    return rank(x, np.array([r["_good"] > 0 for r in rows], bool), pairs)


def score(table: DataFrame, ranking: Ranking, id_col: str = "doc_id") -> DataFrame:
    """(id, score, predicted) of every row of a feature table."""
    schema = pa.schema([(id_col, arrow_type(table, id_col)), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches: Batches) -> Batches:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, WIDTH)
            s = ranking.scores(x)
            yield batch(schema, b.column(0), s, (s >= CUT_SCORE).astype(np.int32))

    return map_arrow(table.select(id_col, "x"), run, schema)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "quality", **how) -> DataFrame:
    """(id, score, predicted) of every document, learned from `labels`."""
    table = stored(feature_table(docs, id_col, text_col))
    return score(table, fit(table, labels, id_col, label_col, **how), id_col)
