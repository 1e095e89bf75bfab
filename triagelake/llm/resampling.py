"""Importance resampling towards a target distribution of hashed n-grams.

1. Overlapped scanning: a text's ASCII capitals are lowered, every run of separators
   becomes one space, and `finditer(overlapped=True)` with lookarounds at the word
   boundaries yields the span of every run of n words. The span's bytes go straight
   into crc32, modulo the number of buckets.
2. Counts per bucket over all documents and over all target texts. A task adds its
   batches up and sends one row per bucket, so no feature is shuffled.
3. A bucket's gain is its smoothed log ratio, target to source, in thousandths and
   rounded down; a document's weight is the floored mean of its features' gains.
4. Gumbel noise from a hash of seed and id turns the weights into a draw without
   replacement: the highest sums are drawn. Ranks come from range partitions and
   their row counts; no task sorts more than one range.

Only the table of gains (one number per bucket, a parameter) is at the driver.

Rows: a text without words (null, empty) has no feature and weight 0. Documents with
fewer than `min_words` words are scored, not drawn. Ties go to the smaller id, a
null id last; repeated rows are drawn one by one. A null id counts as the empty string
in the hash. Other columns are not read. An empty table gives an empty result; an
empty target leaves counts of zero.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm.common import Batches, arrow_type, batch, map_arrow, stored, text_bytes
from triagelake.operators.keyed import ordinal

BUCKETS, GRAMS, SEED, MIN_WORDS, PERCENT = 10_000, 1, 2024, 20, 10
_SEPARATORS = regex.compile(rb"[\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def spans(text: bytes, grams: int) -> Iterator[regex.Match]:
    """Matches of all runs of 1 to `grams` words of a text whose words stand between single spaces."""
    for n in range(1, grams + 1):
        run = regex.compile(rb"(?<![^ ])[^ ]++(?: [^ ]++){%d}(?![^ ])" % (n - 1))
        yield from run.finditer(text, overlapped=True)


def collapsed(text: bytes) -> bytes:
    """Lower-case words between single spaces. Bytes of letters beyond ASCII are word bytes."""
    return _SEPARATORS.sub(b" ", text.lower()).strip(b" ")


def features(text: bytes, grams: int, buckets: int) -> tuple[int, list[int]]:
    """(number of words, bucket of every feature) of a raw text."""
    clean = collapsed(text)
    return (clean.count(b" ") + 1 if clean else 0), [zlib.crc32(m[0]) % buckets for m in spans(clean, grams)]


def bucket_counts(texts: DataFrame, text_col: str, grams: int, buckets: int) -> np.ndarray:
    """Features per bucket over all rows."""
    schema = pa.schema([("bucket", pa.int64()), ("n", pa.int64())])

    def run(batches: Batches) -> Batches:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            found = [f for text in b.column(0) for f in features(text.as_py(), grams, buckets)[1]]
            total += np.bincount(np.array(found, np.int64), minlength=buckets)
        at = np.flatnonzero(total)
        yield batch(schema, at, total[at])

    rows = map_arrow(texts.select(text_bytes(text_col).alias("t")), run, schema).groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for r in rows.collect():
        out[r.bucket] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Log ratio of every bucket with one added to each count, in thousandths, rounded down."""
    s_all, t_all = float(source.sum() + len(source)), float(target.sum() + len(target))
    return np.array([math.floor(1000 * math.log((t + 1.0) * s_all / ((s + 1.0) * t_all)))
                     for s, t in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def noise(seed: int, key) -> int:
    """Gumbel noise in thousandths, rounded down, from the hash of seed and id."""
    h = int(hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weights(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", grams: int = GRAMS,
            seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score) of every row."""
    names = ("n_words", "n_features", "weight", "score")
    schema = pa.schema([(id_col, arrow_type(docs, id_col)), *[(c, pa.int64()) for c in names]])
    buckets = len(gain)

    def run(batches: Batches) -> Batches:
        for b in batches:
            keys, out = b.column(0).to_pylist(), []
            for key, text in zip(keys, b.column(1), strict=True):
                words, found = features(text.as_py(), grams, buckets)
                weight = int(gain[found].sum()) // len(found) if found else 0
                out.append((words, len(found), weight, weight + noise(seed, key)))
            yield batch(schema, b.column(0), *(zip(*out, strict=True) if out else [[]] * 4))

    return map_arrow(docs.select(id_col, text_bytes(text_col).alias("t")), run, schema)


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text",
             grams: int = GRAMS, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT,
             seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row; rank is null where it is not drawn."""
    gain = gains(bucket_counts(docs, text_col, grams, buckets), bucket_counts(target, target_text, grams, buckets))
    # A number of its own for each row parts repeated rows, also between ranges.
    scored = stored(weights(docs, gain, id_col, text_col, grams, seed).withColumn("_row", F.monotonically_increasing_id()))
    eligible = scored.where(F.col("n_words") >= min_words).select(
        "*", (-F.col("score")).alias("_first"), F.col(id_col).isNull().alias("_last"))
    drawn = eligible.count() * percent // 100
    ranked = ordinal(eligible, [], ["_first", "_last", id_col, "_row"], "rank").withColumn(
        "rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    short = scored.where(F.col("n_words") < min_words).withColumn("rank", F.lit(None).cast("long"))
    cols = [id_col, "n_words", "n_features", "weight", "score", "rank"]
    return ranked.select(*cols).unionByName(short.select(*cols))
