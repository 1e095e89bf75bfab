"""Suffix-array dedup: bytes covered by a string of `length` bytes that starts twice.

A sparse suffix array, sorted by a distributed merge sort that uses common prefixes:

1. Texts are grouped by a 64-bit hash, so that copies are looked at once, and stored
   in buckets of that hash: later joins move no text. A checksum tells texts of equal
   hash apart; they get numbers of their own.
2. Anchors: in every window of `length` bytes the gram with the smallest hash (the
   leftmost of equals). Equal windows have their anchor at the same place, so a
   window can only repeat if the gram of its anchor does. Gram counts cover all texts.
3. Runs: each task sorts the suffixes at its repeated anchors, equal ones once, and
   front-codes them: length of the common prefix with the one before, and the rest.
   A suffix is preceded by the hash of its group prefix, so equal ranges of that hash
   are equal shares of the work. Anchors whose gram is frequent are taken apart into
   steps of STEP starts with a group prefix of nearly `length` bytes.
4. Each range gathers its part of all runs and merges them by a loser tree on
   common-prefix lengths: bytes up to a known common prefix are never compared again.
   The merged order gives right matches; left contexts of a group give left matches;
   both together say for each window whether another start has it.

Rows: a null text is empty. Texts shorter than `length` keep all their bytes; a text
of two or more rows, at least that long, is removed whole from all of them. Null and
repeated ids are rows like others. Other columns are not read. An empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.llm.common import Batches, batch, map_arrow, shuffle_partitions, stored, text_bytes

LENGTH = 200
GRAM = 32
STEP = 8                        # starts that share a group prefix, where a gram is frequent
FREQUENT = 4096                 # occurrences from which a gram is frequent
SEGMENT = 1 << 19               # bytes hashed at once; below 2^24, for the place bits
RUN_SUFFIXES = 200_000          # suffixes a task sorts at once
RANGE_SUFFIXES = 20_000         # suffixes a range holds on average
_PLACE = np.uint64((1 << 24) - 1)
_PRIME = 0x9E3779B97F4A7C15
_M64 = (1 << 64) - 1


# ---- anchors -----------------------------------------------------------------------

def gram_hashes(data: np.ndarray, n: int) -> np.ndarray:
    """Mixed polynomial hashes of all grams of n bytes, n a power of two."""
    h, p, s = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(_PRIME), _PRIME, 1
    while s < n:
        h = h[:-s] * np.uint64(p) + h[s:]
        p, s = p * p & _M64, 2 * s
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    s = 1
    while 2 * s <= w:
        v, s = np.minimum(v[:-s], v[s:]), 2 * s
    return np.minimum(v[:len(v) - (w - s)], v[w - s:]) if s < w else v


def anchors(texts: list[bytes], length: int = LENGTH, gram: int = GRAM):
    """Arrays (text, place, gram hash, first start, last start) of the anchors of all windows."""
    parts, filled, out = [], 0, []

    def work() -> None:
        data = np.frombuffer(b"".join(p[2] for p in parts), np.uint8)
        if len(data) < length:
            return
        sizes = np.array([len(p[2]) for p in parts])
        ends = np.cumsum(sizes)
        g = gram_hashes(data, gram)
        low = sliding_min((g & ~_PLACE) | np.arange(len(g), dtype=np.uint64), length - gram + 1)
        place = (low & _PLACE).astype(np.int64)
        start = np.arange(len(place))
        part = np.searchsorted(ends, start, "right")
        inside = start + length <= ends[part]
        start, place, part = start[inside], place[inside], part[inside]
        if not len(start):
            return
        new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (part[1:] != part[:-1])])
        last = np.r_[new[1:], len(start)] - 1
        shift = np.array([p[1] for p in parts]) - (ends - sizes)
        move = shift[part[new]]
        text = np.array([p[0] for p in parts])[part[new]]
        out.append((text, place[new] + move, g[place[new]].view(np.int64), start[new] + move, start[last] + move))

    for i, t in enumerate(texts):
        at = 0
        while len(t) - at >= length:
            piece = t[at:at + SEGMENT]
            parts.append((i, at, piece))
            filled += len(piece)
            at += len(piece) - length + 1       # the next piece starts at the first window not seen
            if filled >= SEGMENT:
                work()
                parts, filled = [], 0
    if parts:
        work()
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


# ---- common prefixes ---------------------------------------------------------------

def common(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, of which `known` bytes need no comparison."""
    end = min(len(a), len(b))
    if a[known:end] == b[known:end]:
        return end
    step = 16
    while a[known:known + step] == b[known:known + step]:
        known += step
        step *= 2
    while step > 1:
        step //= 2
        if a[known:known + step] == b[known:known + step]:
            known += step
    return known


class LoserTree:
    """Merges sorted runs of (string, common prefix with the one before, payload).

    Every contender knows its common prefix with the last winner. The longer one
    wins unseen; bytes are compared behind equal ones only.
    """

    def __init__(self, runs: list):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        self.known = [0] * len(runs)
        size = 1
        while size < len(runs):
            size *= 2
        self.size, self.losers = size, [-1] * size
        self.winner = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.size:
            run = node - self.size
            return run if run < len(self.heads) and self.heads[run] is not None else -1
        winner, self.losers[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return winner

    def _play(self, x: int, y: int) -> tuple[int, int]:
        """(winner, loser); the loser's known prefix becomes that with the winner."""
        if x < 0 or y < 0:
            return (y, x) if x < 0 else (x, y)
        hx, hy = self.known[x], self.known[y]
        if hx != hy:
            return (x, y) if hx > hy else (y, x)
        a, b = self.heads[x][0], self.heads[y][0]
        h = common(a, b, hx)
        if h == len(a) or h < len(b) and a[h] < b[h]:
            self.known[y] = h
            return x, y
        self.known[x] = h
        return y, x

    def __iter__(self):
        """(string, common prefix with the string before, payload) of all runs in order."""
        heads, known, losers = self.heads, self.known, self.losers
        while self.winner >= 0:
            run = self.winner
            string, _, payload = heads[run]
            yield string, known[run], payload
            heads[run] = next(self.runs[run], None)
            if heads[run] is None:
                winner = -1
            else:
                known[run] = heads[run][1]      # inside a run the common prefix is stored
                winner = run
            node = (run + self.size) // 2
            while node:
                winner, losers[node] = self._play(winner, losers[node])
                node //= 2
            self.winner = winner


# ---- runs --------------------------------------------------------------------------

_HEAD = "<BHHHI"                    # frequent, common prefix, rest of the suffix, left context, places


def front_coded(entries: list[tuple[bytes, bytes, int, list]]) -> bytes:
    """A run: sorted (string, reversed left context, frequent, [(text key, place)])."""
    out, before = [], b""
    for string, left, frequent, places in entries:
        h = common(before, string)
        out += [struct.pack(_HEAD, frequent, h, len(string) - h, len(left), len(places)), string[h:], left,
                np.array(places, "<i8").tobytes()]
        before = string
    return zstandard.compress(b"".join(out), 3)


def decoded(block: bytes):
    """(string, common prefix with the one before, (left, frequent, places)) of a run, one by one."""
    raw, at, before = zstandard.decompress(block), 0, b""
    while at < len(raw):
        frequent, h, rest, n_left, n_places = struct.unpack_from(_HEAD, raw, at)
        at += struct.calcsize(_HEAD)
        before = before[:h] + raw[at:at + rest]
        at += rest
        left = raw[at:at + n_left]
        at += n_left
        places = np.frombuffer(raw, "<i8", 2 * n_places, at).reshape(-1, 2)
        at += 16 * n_places
        yield before, h, (left, frequent, places)


def _suffixes(text: bytes, place: int, first: int, last: int, frequent: bool, length: int, gram: int):
    """(string, reversed left context, frequent, place) of an anchor's windows."""
    if not frequent:
        prefix = struct.pack(">Q", xxhash.xxh64_intdigest(text[place:place + gram]))
        yield prefix + text[place:last + length], text[first:place][::-1], 0, place
        return
    # Windows that start in [place - b - STEP + 1, place - b] have the bytes from place - b in common.
    group = length - STEP + 1
    for b in range((place - last) // STEP * STEP, place - first + 1, STEP):
        at = place - b
        low, high = max(first, at - STEP + 1), min(last, at)
        prefix = struct.pack(">Q", xxhash.xxh64_intdigest(text[at:at + group], 1))
        yield prefix + text[at:high + length], text[low:at][::-1], 1, at


def _write_runs(texts: DataFrame, ranges: int, length: int, gram: int) -> DataFrame:
    """texts (k, t, at) -> (range, run): `at` holds the repeated anchors' places, doubled, plus 1 if frequent."""
    schema = pa.schema([("range", pa.int32()), ("run", pa.binary())])

    def close(found: dict) -> pa.RecordBatch:
        entries = sorted((s, left, freq, places) for (s, left, freq), places in found.items())
        ids = [int.from_bytes(e[0][:8], "big") * ranges >> 64 for e in entries]
        cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
        return batch(schema, [ids[a] for a in cuts[:-1]],
                     [front_coded(entries[a:z]) for a, z in zip(cuts[:-1], cuts[1:], strict=True)])

    def run(batches: Batches) -> Batches:
        found: dict = {}
        for b in batches:
            keys, raw = b.column(0).to_pylist(), b.column(1).to_pylist()
            wanted = [dict((v >> 1, v & 1) for v in at) for at in b.column(2).to_pylist()]
            for i, place, _, first, last in zip(*(c.tolist() for c in anchors(raw, length, gram)), strict=True):
                frequent = wanted[i].get(place)
                if frequent is not None:
                    for s, left, freq, at in _suffixes(raw[i], place, first, last, bool(frequent), length, gram):
                        found.setdefault((s, left, freq), []).append((keys[i], at))
            if len(found) >= RUN_SUFFIXES:
                yield close(found)
                found = {}
        if found:
            yield close(found)

    return map_arrow(texts.select("k", "t", "at"), run, schema)


# ---- groups ------------------------------------------------------------------------

def _bits(low: int, high: int) -> int:
    return (1 << high + 1) - (1 << low) if low <= high else 0


def repeated_offsets(group: list[tuple[int, int, bytes, int]], length: int) -> list[int]:
    """For each suffix of a group, the set (as bits) of b for which the window that starts b bytes before it repeats.

    A suffix is (common prefix with the one before, own bytes, reversed left context,
    number of places), in sorted order. A window with b left bytes needs length - b right ones.
    """
    m = len(group)
    own = [_bits(max(0, length - size), len(left)) for _, size, left, _ in group]
    out = [own[i] if group[i][3] > 1 else 0 for i in range(m)]
    if m <= 24:
        for i in range(m):
            right = group[i][1]
            for j in range(i + 1, m):
                right = min(right, group[j][0], group[j][1])
                both = _bits(max(0, length - right), common(group[i][2], group[j][2])) & own[i] & own[j]
                out[i] |= both
                out[j] |= both
        return out
    right = np.array([g[0] for g in group])
    order = sorted(range(m), key=lambda i: group[i][2])
    left = np.zeros(m, np.int64)
    left[1:] = [common(group[a][2], group[b][2]) for a, b in zip(order[:-1], order[1:], strict=True)]
    order = np.array(order)
    low = np.array([max(0, length - g[1]) for g in group])
    high = np.array([len(g[2]) for g in group])
    many = np.array([min(g[3], 2) for g in group])
    for b in range(int(low.min()), int(high.max()) + 1):
        valid = (low <= b) & (b <= high)
        if not valid.any():
            continue
        by_left = np.zeros(m, np.int64)
        by_left[order] = np.cumsum(left < b)
        code = np.cumsum(right < length - b) * (m + 1) + by_left
        _, at, = np.unique(code[valid], return_inverse=True)
        repeated = np.bincount(at, many[valid])[at] > 1
        for i in np.flatnonzero(valid)[repeated]:
            out[i] |= 1 << b
    return out


def _intervals(bits: int):
    """(low, high) of the runs of set bits."""
    low = 0
    while bits:
        gap = (bits & -bits).bit_length() - 1
        bits, low = bits >> gap, low + gap
        n = ((bits + 1) & ~bits).bit_length() - 1
        yield low, low + n - 1
        bits, low = bits >> n, low + n


def _merge_runs(runs: DataFrame, length: int, gram: int) -> DataFrame:
    """(k, start, end): byte intervals covered by repeated windows."""
    schema = pa.schema([("k", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])

    def merge(t: pa.Table) -> pa.Table:
        cols: list[list[np.ndarray]] = [[], [], []]
        group, places = [], []

        def close() -> None:
            for bits, at in zip(repeated_offsets(group, length), places, strict=True):
                for low, high in _intervals(bits):
                    cols[0].append(at[:, 0])
                    cols[1].append(at[:, 1] - high)
                    cols[2].append(at[:, 1] - low + length)

        for string, h, (left, frequent, at) in LoserTree([decoded(r.as_py()) for r in t.column("run")]):
            prefix = 8 + (length - STEP + 1 if frequent else gram)
            if group and h < prefix:
                close()
                group, places = [], []
            if group and h == len(string) and len(string) - 8 == group[-1][1] and left == group[-1][2]:
                places[-1] = np.concatenate([places[-1], at])
                group[-1] = (*group[-1][:3], len(places[-1]))
            else:
                group.append((h - 8, len(string) - 8, left, len(at)))
                places.append(at)
        if group:
            close()
        return pa.table([np.concatenate(c) if c else np.zeros(0, np.int64) for c in cols], schema=schema)

    return runs.groupBy("range").applyInArrow(merge, "k long, start long, end long")


# ---- the whole ---------------------------------------------------------------------

# ---- texts -------------------------------------------------------------------------

def text_hash(text: Column) -> Column:
    return F.xxhash64(text)


@contextmanager
def _distinct_texts(docs: DataFrame, text_col: str):
    """(k, h, c, t, n) of the distinct texts with their numbers of rows, in buckets of k; dropped at the end.

    A text is known by its hash h and its checksum c, 96 bits. k is h; where different
    texts share h, they are counted again, each under a number of its own.
    """
    spark, name = docs.sparkSession, f"texts_{uuid.uuid4().hex}"
    rows = docs.select(text_bytes(text_col).alias("t")).select(text_hash(F.col("t")).alias("h"), F.crc32("t").alias("c"), "t")

    def write(df: DataFrame) -> None:
        df.select("k", "h", "c", "d", "t", "n").write.mode("append").option("compression", "zstd").bucketBy(
            shuffle_partitions(spark), "k").saveAsTable(name)

    one = [F.first("t").alias("t"), F.count("*").alias("n")]
    try:
        write(rows.withColumnRenamed("h", "k").groupBy("k").agg(F.min("c").alias("c"), F.max("c").alias("d"), *one)
              .withColumn("h", F.col("k")))
        table = spark.table(name)
        shared = stored(table.where("c <> d").select("h"))
        if not shared.isEmpty():
            apart = rows.join(shared, "h", "left_semi").groupBy("h", "c").agg(*one)
            write(apart.withColumn("k", F.xxhash64("h", "c")).withColumn("d", F.col("c")))
            spark.catalog.refreshTable(name)
            table = spark.table(name)
            if not table.where("c = d").groupBy("k").agg(F.count("*").alias("m")).where("m > 1").isEmpty():
                raise ValueError("two texts share three hashes")
        yield table.where("c = d").select("k", "h", "c", "t", "n")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


# ---- spans -------------------------------------------------------------------------

def repeated_spans(texts: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """texts (k, t) -> (k, spans): intervals of repeated windows, unmerged."""
    schema = pa.schema([("gram", pa.int64()), ("k", pa.int64()), ("place", pa.int32())])

    def scan(batches: Batches) -> Batches:
        for b in batches:
            text, place, g, _, _ = anchors(b.column(1).to_pylist(), length, gram)
            yield batch(schema, g, b.column(0).take(pa.array(text)), place.astype(np.int32))

    all_anchors = map_arrow(texts.where(F.octet_length("t") >= length).select("k", "t"), scan, schema)
    # Stored, so that both sides of the join below come from a shuffle of their own and a hot gram is split.
    grams = stored(all_anchors.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
                   .select("gram", (F.col("n") > FREQUENT).cast("int").alias("frequent")))
    found = stored(all_anchors.join(grams, "gram").select(
        "k", (F.col("place") * 2 + F.col("frequent")).alias("v")).groupBy("k").agg(F.collect_list("v").alias("at")))
    total = found.agg(F.coalesce(F.sum(F.size("at")), F.lit(0))).first()[0]
    ranges = max(shuffle_partitions(texts.sparkSession), total // RANGE_SUFFIXES)
    runs = _write_runs(texts.join(found.hint("shuffle_hash"), "k"), ranges, length, gram)
    return stored(_merge_runs(runs, length, gram)).groupBy("k").agg(
        F.collect_list(F.struct("start", "end")).alias("spans"))


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH,
          gram: int = GRAM, with_text: bool = False) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row."""
    fields = [("_h", pa.int64()), ("_c", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()),
              ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
    schema = pa.schema(fields + ([("kept", pa.binary())] if with_text else []))

    def run(batches: Batches) -> Batches:
        for b in batches:
            out = []
            for h, c, t, n, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if n > 1 and len(t) >= length:
                    cut = [(0, len(t))]
                else:
                    cut = merged([(s["start"], s["end"]) for s in found or []])
                kept, at = [], 0
                for a, z in cut:
                    kept.append(t[at:a])
                    at = z
                rest = b"".join([*kept, t[at:]]) if cut else t
                row = (h, c, len(t), len(t) - len(rest), len(cut), hashlib.sha256(rest).hexdigest())
                out.append((*row, rest) if with_text else row)
            if out:
                yield batch(schema, *zip(*out, strict=True))

    with _distinct_texts(docs, text_col) as texts:
        spans = repeated_spans(texts, length, gram)
        digests = stored(map_arrow(texts.join(spans.hint("shuffle_hash"), "k", "left").select("h", "c", "t", "n", "spans"),
                                   run, schema))
    text = text_bytes(text_col)
    rows = docs.select(id_col, text_hash(text).alias("_h"), F.crc32(text).alias("_c"))
    return rows.join(digests, ["_h", "_c"]).drop("_h", "_c")
