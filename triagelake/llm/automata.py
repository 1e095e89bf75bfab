"""Substring dedup over words: broadcast suffix automata of reference shards.

A word is covered by a window of `length` words that starts twice. The reference is
the corpus itself, reduced to what can repeat and cut into shards:

1. Equal texts are one text with a number of rows. In every window of `length` words
   the gram of `gram` words with the smallest hash (the leftmost of equals) is its
   anchor; the windows of one anchor are one region of at most 2 * length - gram
   words. Equal windows have equal anchors, so only regions whose anchor gram occurs
   twice are looked at. Grams with more than `wide` different regions (a common
   phrase in many surroundings) are taken apart into the windows that occur twice.
2. A shard is a range of the hash of grams, of about `shard_words` words of distinct
   regions (copies of a region meet in the map-side aggregate). One task builds the
   suffix automaton of a shard and keeps the states that occur twice and lead to a
   repeated string of `length` words: all others tell nothing about a repeat. A region
   that is the only one of its gram repeats in its copies alone and is kept as it is.
3. Shards are broadcast a wave at a time, at most `wave_bytes` of them (checked), and
   the regions of all documents in those shards stream past them without a shuffle,
   so a passage that a third of all documents share is no burden to any one task. The
   matching statistic of a position is the longest string ending there that occurs
   twice; where it reaches `length`, that many words are covered.

Hashes only choose what to compare. The automata hold the words themselves, so the
result is exact.

Words are runs of other characters than space and the ASCII controls 9 to 13. Rows: a
null, empty or blank text has no words. Texts with fewer than `length` words keep all of
them; a text of two or more rows, at least that long, is removed whole from all of
them. Null and repeated ids are rows like others. Other columns are not read. An
empty table gives an empty result. Memory of a task grows with the longest text only.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.llm.common import Batches, batch, distinct_texts, map_arrow, shuffle_partitions, stored, text_bytes, text_key
from triagelake.llm.suffixes import merged, sliding_min
from triagelake.session import checkpoint_root

LENGTH, GRAM = 35, 12
WIDE = 1000                     # distinct regions from which a gram's windows are taken one by one
SHARD_WORDS = 100_000
WAVE_SHARDS, WAVE_BYTES = 48, 16 << 20
SEGMENT = 1 << 19               # bytes, and words, hashed at once
REMEMBERED = 20_000             # regions of a shard a task remembers
_PLACE = np.uint64((1 << 24) - 1)
_PRIME = 0x9E3779B97F4A7C15
_INVERSE = pow(_PRIME, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


# ---- anchors -----------------------------------------------------------------------

def _power(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; the usual length is kept."""
    if n <= SEGMENT:
        if base not in _powers:
            _powers[base] = _power_table(base, SEGMENT)
        return _powers[base][:n]
    return _power_table(base, n)


def _power_table(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the runs values[start:end], equal for equal runs wherever they stand."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum((values + np.uint64(1)) * _power(_PRIME, len(values)), out=total[1:])
    h = (total[ends] - total[starts]) * _power(_INVERSE, len(values) + 1)[starts]
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def _word_hashes(text: bytes) -> np.ndarray:
    """Hashes of all words, a segment of bytes at a time, cut where no word is."""
    out, at = [], 0
    while at < len(text):
        end = min(at + SEGMENT, len(text))
        while end < len(text) and text[end] not in b"\x20\x09\x0a\x0b\x0c\x0d":
            end += 1
        data = np.frombuffer(text, np.uint8, end - at, at)
        word = np.zeros(len(data) + 2, bool)
        word[1:-1] = (data != 32) & ((data < 9) | (data > 13))
        edges = np.flatnonzero(word[1:] != word[:-1])
        out.append(run_hashes(data.astype(np.uint64), edges[::2], edges[1::2]))
        at = end
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def regions(texts: list[bytes], length: int, gram: int):
    """Arrays (text, anchor gram, region hash, first word, number of words) of the regions of all texts."""
    out = []

    def work(parts: list[tuple[int, int, np.ndarray]]) -> None:
        words = np.concatenate([p[2] for p in parts])
        if len(words) < length:
            return
        sizes = np.array([len(p[2]) for p in parts])
        ends = np.cumsum(sizes)
        at = np.arange(len(words) - gram + 1)
        grams = run_hashes(words, at, at + gram)
        low = sliding_min((grams & ~_PLACE) | at.astype(np.uint64), length - gram + 1)
        place, start = (low & _PLACE).astype(np.int64), np.arange(len(low))
        part = np.searchsorted(ends, start, "right")
        inside = start + length <= ends[part]
        start, place, part = start[inside], place[inside], part[inside]
        if not len(start):
            return
        new = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (part[1:] != part[:-1])])
        first, size = start[new], start[np.r_[new[1:], len(start)] - 1] - start[new] + length
        own = run_hashes(words, first, first + size)
        move = (np.array([p[1] for p in parts]) - (ends - sizes))[part[new]]
        out.append((np.array([p[0] for p in parts])[part[new]], grams[place[new]].view(np.int64), own.view(np.int64),
                    first + move, size))

    parts, filled = [], 0
    for i, text in enumerate(texts):
        hashes, at = _word_hashes(text), 0
        while len(hashes) - at >= length:
            parts.append((i, at, hashes[at:at + SEGMENT]))
            filled += len(parts[-1][2])
            at += len(parts[-1][2]) - length + 1        # the next part starts at the first window not seen
            if filled >= SEGMENT:
                work(parts)
                parts, filled = [], 0
    if parts:
        work(parts)
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else tuple(np.zeros((5, 0), np.int64))


# ---- automata ----------------------------------------------------------------------

class Automaton:
    """The part of a suffix automaton that leads to strings of `length` words that occur twice.

    step, link and length are those of the kept states; state 0 is the empty string.
    """

    def __init__(self, step: list[dict[bytes, int]], link: list[int], length: list[int]):
        self.step, self.link, self.length = step, link, length

    @classmethod
    def build(cls, strings: list[tuple[list[bytes], int]], least: int) -> Automaton | None:
        """Of strings with numbers of occurrences; None if no string of `least` words occurs twice."""
        step, link, length, count = [{}], [-1], [0], [0]
        for words, times in strings:
            last = 0
            for w in words:
                at = step[last].get(w)
                if at is None:
                    new = len(step)
                    step.append({})
                    length.append(length[last] + 1)
                    link.append(0)
                    count.append(times)
                    while last >= 0 and (at := step[last].get(w)) is None:
                        step[last][w] = new
                        last = link[last]
                    if last >= 0:
                        link[new] = at if length[at] == length[last] + 1 else _split(step, link, length, count, last, w, at)
                    last = new
                else:
                    last = at if length[at] == length[last] + 1 else _split(step, link, length, count, last, w, at)
                    count[last] += times
        order = sorted(range(len(step)), key=length.__getitem__, reverse=True)
        for v in order[:-1]:
            count[link[v]] += count[v]
        keep = [False] * len(step)
        for v in order:
            if count[v] > 1:
                if length[v] >= least:
                    keep[v] = True
                else:
                    for u in step[v].values():
                        if keep[u]:
                            keep[v] = True
                            break
        if not keep[0]:
            return None
        # Suffixes that lead nowhere are passed over; a link is always shorter than its state.
        near, number, kept = [0] * len(step), {}, []
        for v in reversed(order):
            if v:
                near[v] = link[v] if keep[link[v]] else near[link[v]]
            if keep[v]:
                number[v] = len(kept)
                kept.append(v)
        moves = [{w: number[u] for w, u in step[v].items() if keep[u]} for v in kept]
        return cls(moves, [number[near[v]] for v in kept], [length[v] for v in kept])

    def to_bytes(self) -> bytes:
        names: dict[bytes, int] = {}
        words = [names.setdefault(w, len(names)) for moves in self.step for w in moves]
        arrays = [[len(self.link), len(words)], self.link, self.length, list(map(len, self.step)),
                  [u for moves in self.step for u in moves.values()], words]
        return b"".join([*(np.array(a, "<i4").tobytes() for a in arrays), b" ".join(names)])

    @classmethod
    def from_bytes(cls, raw: bytes) -> Automaton:
        states, moves = np.frombuffer(raw, "<i4", 2).tolist()
        at, arrays = 8, []
        for n in (states, states, states, moves, moves):
            arrays.append(np.frombuffer(raw, "<i4", n, at).tolist())
            at += 4 * n
        link, length, sizes, to, names = arrays
        words = raw[at:].split(b" ")
        pairs = zip([words[i] for i in names], to, strict=True)
        return cls([dict(islice(pairs, n)) for n in sizes], link, length)

    def statistics(self, words: list[bytes]) -> Iterator[int]:
        """For each word, the length of the longest kept string that ends with it."""
        step, link, length = self.step, self.link, self.length
        state = known = 0
        for w in words:
            while (to := step[state].get(w)) is None and state:
                state = link[state]
                known = length[state]
            if to is None:
                known = 0
            else:
                state, known = to, known + 1
            yield known


class Shard:
    """What repeats in a range of grams: an automaton, and regions that are alone with their gram as a whole.

    A region without another of its gram can only repeat in its own copies.
    """

    def __init__(self, block: bytes):
        n = int.from_bytes(block[:8], "little")
        self.alone = set(zstandard.decompress(block[8:8 + n]).split(b"\n"))
        self.automaton = Automaton.from_bytes(zstandard.decompress(block[8 + n:])) if len(block) > 8 + n else None

    @staticmethod
    def block(rows: list[tuple[int, bytes, int]], length: int) -> bytes:
        """Of rows (key, words, occurrences); empty if nothing repeats."""
        kinds = Counter(key for key, _, _ in rows)
        alone = [words for key, words, n in rows if kinds[key] == 1 and n > 1]
        made = Automaton.build([(words.split(b" "), n) for key, words, n in rows if kinds[key] > 1], length)
        if not alone and not made:
            return b""
        first = zstandard.compress(b"\n".join(alone), 3)      # no word holds a line feed
        return len(first).to_bytes(8, "little") + first + (zstandard.compress(made.to_bytes(), 3) if made else b"")

    def covers(self, words: bytes, length: int) -> list[tuple[int, int]]:
        """Maximal runs of covered words of a region."""
        if words in self.alone:
            return [(0, words.count(b" ") + 1)]
        if not self.automaton:
            return []
        return merged([(e - length, e) for e, n in enumerate(self.automaton.statistics(words.split(b" ")), 1) if n >= length])


def _split(step: list[dict], link: list[int], length: list[int], count: list[int], last: int, word: bytes,
           at: int) -> int:
    """A state of its own for the strings of `at` that are reached from `last`."""
    new = len(step)
    step.append(step[at].copy())
    length.append(length[last] + 1)
    link.append(link[at])
    count.append(0)
    link[at] = new
    while last >= 0 and step[last].get(word) == at:
        step[last][word] = new
        last = link[last]
    return new


# ---- steps -------------------------------------------------------------------------

def _found(texts: DataFrame, length: int, gram: int, wide: int) -> tuple[DataFrame, int]:
    """(k, at) of texts with regions to compare, at = [(key, first, size)]; the words of distinct regions in all."""
    schema = pa.schema([("gram", pa.int64()), ("own", pa.int64()), ("k", pa.binary()), ("first", pa.int32()),
                        ("size", pa.int32())])

    def scan(batches: Batches) -> Batches:
        for b in batches:
            text, grams, own, first, size = regions(b.column(1).to_pylist(), length, gram)
            yield batch(schema, grams, own, b.column(0).take(pa.array(text)), first.astype(np.int32), size.astype(np.int32))

    found = stored(map_arrow(texts.select("k", "t"), scan, schema))
    distinct = found.groupBy("gram", "own").agg(F.count("*").alias("n"), F.first("size").alias("size"))
    # Stored, so that both sides of the joins come from a shuffle of their own and a hot gram is split.
    grams = stored(distinct.groupBy("gram").agg(
        F.sum("n").alias("n"), F.count("*").alias("kinds"), F.sum("size").alias("words")).where("n > 1").drop("n"))
    narrow = found.join(grams.where(F.col("kinds") <= wide).select("gram"), "gram").select(
        "k", F.col("gram").alias("key"), "first", "size")
    windows = _windows(texts, found.join(grams.where(F.col("kinds") > wide).select("gram"), "gram"), length)
    words = grams.where(F.col("kinds") <= wide).agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    words += length * windows.agg(F.approx_count_distinct("key")).first()[0]
    # The regions of a text: no more than it has words.
    at = narrow.unionByName(windows).groupBy("k").agg(F.collect_list(F.struct("key", "first", "size")).alias("at"))
    return stored(at), words


def _windows(texts: DataFrame, wide: DataFrame, length: int) -> DataFrame:
    """(k, key, first, size) of the windows of wide regions that occur twice, by their hash."""
    schema = pa.schema([("key", pa.int64()), ("k", pa.binary()), ("first", pa.int32())])

    def run(batches: Batches) -> Batches:
        for b in batches:
            keys, at, first = [], [], []
            for i, (text, found) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                words = _word_hashes(text)
                for r in found:
                    starts = np.arange(r["first"], r["first"] + r["size"] - length + 1)
                    part = words[starts[0]:starts[-1] + length]
                    keys.append(run_hashes(part, starts - starts[0], starts - starts[0] + length).view(np.int64))
                    at.append(np.full(len(starts), i))
                    first.append(starts.astype(np.int32))
            if keys:
                text = pa.array(np.concatenate(at))
                yield batch(schema, np.concatenate(keys), b.column(0).take(text), np.concatenate(first))

    at = wide.groupBy("k").agg(F.collect_list(F.struct("first", "size")).alias("at"))
    every = stored(map_arrow(texts.select("k", "t").join(at.hint("shuffle_hash"), "k"), run, schema))
    twice = stored(every.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"))
    return stored(every.join(twice, "key").select("k", "key", "first", F.lit(length).alias("size")))


def _strings(texts: DataFrame, found: DataFrame, shards: int) -> DataFrame:
    """(shard, key, k, first, words, wave): the regions with their words, the rows of a shard side by side.

    Stored by wave; a large shard is split between tasks.
    """
    schema = pa.schema([("shard", pa.int32()), ("key", pa.int64()), ("k", pa.binary()), ("first", pa.int32()),
                        ("words", pa.binary())])

    def run(batches: Batches) -> Batches:
        for b in batches:
            shard, keys, at, first, strings = [], [], [], [], []
            for i, (text, found) in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                words = text.split()
                for r in found:
                    key, start, size = r["key"], r["first"], r["size"]
                    shard.append((key * _PRIME & (1 << 64) - 1) * shards >> 64)     # anchors have small hashes
                    keys.append(key)
                    at.append(i)
                    first.append(start)
                    strings.append(b" ".join(words[start:start + size]))
            yield batch(schema, shard, keys, b.column(0).take(pa.array(at, pa.int64())), first, strings)

    made = map_arrow(texts.select("k", "t").join(found.hint("shuffle_hash"), "k"), run, schema)
    wave = F.floor(F.col("shard") / WAVE_SHARDS).cast("int")
    return stored(made.withColumn("wave", wave).hint("rebalance", "shard").sortWithinPartitions("wave", "shard"), "wave")


def _automata(strings: DataFrame, shards: int, length: int) -> DataFrame:
    """(shard, block, size) of the shards with a repeat."""
    schema = pa.schema([("shard", pa.int32()), ("block", pa.binary()), ("size", pa.int64())])

    def build(t: pa.Table) -> pa.Table:
        block = Shard.block(list(zip(*(t.column(c).to_pylist() for c in ("key", "words", "n")), strict=True)), length)
        return pa.table([t.column("shard").combine_chunks()[:1], [block], [len(block)]], schema=schema)

    distinct = strings.groupBy("shard", "key", "words").agg(F.count("*").alias("n"))
    parts = max(shuffle_partitions(strings.sparkSession), shards)
    blocks = distinct.repartition(parts, "shard").groupBy("shard").applyInArrow(build, "shard int, block binary, size long")
    return stored(blocks.where("size > 0"))


def _waves(automata: DataFrame, shards: int, limit: int) -> Iterator[dict[int, bytes]]:
    """The automata in waves of at most `limit` bytes, or one shard."""
    for low in range(0, shards, WAVE_SHARDS):
        some = automata.where(F.col("shard").between(low, low + WAVE_SHARDS - 1))
        wave, filled = [], 0
        for shard, size in some.select("shard", "size").orderBy("shard").collect():
            if wave and filled + size > limit:
                yield dict(some.where(F.col("shard").isin(wave)).select("shard", "block").collect())
                wave, filled = [], 0
            wave.append(shard)
            filled += size
        if wave:
            yield dict(some.where(F.col("shard").isin(wave)).select("shard", "block").collect())


def _stream(strings: DataFrame, wave: dict[int, bytes], length: int, path: str) -> None:
    """Writes (k, start, end): words covered in the regions of the wave's shards."""
    shared = strings.sparkSession.sparkContext.broadcast(wave)
    schema = pa.schema([("k", pa.binary()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Batches) -> Batches:
        at_shard, made, known = -1, None, {}
        for b in batches:
            at, starts, ends = [], [], []
            for i, (shard, first, raw) in enumerate(zip(*(b.column(c).to_pylist() for c in (0, 2, 3)), strict=True)):
                if shard != at_shard:                   # rows come by shard
                    at_shard, made, known = shard, Shard(shared.value[shard]), {}
                cover = known.get(raw)
                if cover is None:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    cover = known[raw] = made.covers(raw, length)
                for a, z in cover:
                    at.append(i)
                    starts.append(first + a)
                    ends.append(first + z)
            yield batch(schema, b.column(1).take(pa.array(at, pa.int64())), starts, ends)

    rows = strings.where((F.col("wave") == min(wave) // WAVE_SHARDS) & F.col("shard").isin(list(wave)))
    map_arrow(rows.select("shard", "k", "first", "words"), run, schema).write.parquet(path)
    shared.destroy()


def covered(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, wide: int = WIDE, shard_words: int = SHARD_WORDS,
            wave_bytes: int = WAVE_BYTES) -> DataFrame | None:
    """texts (k, t), all different -> (k, spans): words covered by repeated windows, unmerged; None if nothing repeats."""
    spark = texts.sparkSession
    found, words = _found(texts, length, gram, wide)
    shards = max(1, -(-words // shard_words))
    strings = _strings(texts, found, shards)
    path, waves = f"{checkpoint_root(spark).rstrip('/')}/llm-{uuid.uuid4().hex}", 0
    for wave in _waves(_automata(strings, shards, length), shards, wave_bytes):
        _stream(strings, wave, length, f"{path}/wave={waves}")
        waves += 1
    if not waves:
        return None
    spans = spark.read.schema("k binary, start int, end int").parquet(path)
    return spans.groupBy("k").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
          wide: int = WIDE, shard_words: int = SHARD_WORDS, wave_bytes: int = WAVE_BYTES,
          with_text: bool = False) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept]) of every row."""
    with distinct_texts(docs, text_col) as texts:
        spans = covered(texts, length, gram, wide, shard_words, wave_bytes)
        joined = texts.withColumn("spans", F.lit(None).cast("array<struct<start:int,end:int>>")) if spans is None else \
            texts.join(spans.hint("shuffle_hash"), "k", "left")
        fields = [("k", pa.binary()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]
        schema = pa.schema(fields + ([("kept", pa.binary())] if with_text else []))

        def run(batches: Batches) -> Batches:
            for b in batches:
                out = []
                for k, text, n, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    words = text.split()
                    if n > 1 and len(words) >= length:
                        cut = [(0, len(words))]
                    else:
                        cut = merged([(s["start"], s["end"]) for s in found or []])
                    kept, at = [], 0
                    for a, z in cut:
                        kept += words[at:a]
                        at = z
                    kept += words[at:]
                    rest = b" ".join(kept)
                    row = (k, len(words), len(words) - len(kept), hashlib.sha256(rest).hexdigest())
                    out.append((*row, rest) if with_text else row)
                if out:
                    yield batch(schema, *zip(*out, strict=True))

        digests = stored(map_arrow(joined.select("k", "t", "n", "spans"), run, schema))
    rows = docs.select(id_col, text_key(text_bytes(text_col)).alias("_k"))
    return rows.join(digests.withColumnRenamed("k", "_k"), "_k").drop("_k")
