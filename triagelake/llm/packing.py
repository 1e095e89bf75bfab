"""Packing of token sequences: shortest-pack-first over the length histogram.

A document's ids, closed by an end id, are cut into full pieces of `capacity`
and one rest. The rests are packed by length only: a histogram of at most
`capacity` bins goes to the driver, lengths are placed longest first into the
emptiest pattern that has room, and patterns carry a count. Documents find their
place by joining their rank among the rests of equal length with the pattern
slots.

Rows: a null or empty text is the end id alone. Each row is a document, repeated
rows too. Ties of length are ranked by the order of the input files. Other columns
are not read. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from triagelake.llm.common import Batches, arrow_type, batch, map_arrow, stored, text_or_empty
from triagelake.llm.tokens import CACHE, encoder

CAPACITY = 2048
END_ID = 1

Pattern = tuple[tuple[int, ...], int]


def shortest_pack_first(histogram: dict[int, int], capacity: int) -> list[Pattern]:
    """(lengths of a pack, number of such packs) that hold every sequence of the histogram once."""
    free: list[int] = []                                # rooms in use, emptiest first (negated)
    packs: dict[int, list[Pattern]] = {}                # by room left
    done: list[Pattern] = []

    def put(lengths: tuple[int, ...], count: int, room: int) -> None:
        if room == 0:
            done.append((lengths, count))
            return
        if not packs.get(room):
            heapq.heappush(free, -room)
            packs[room] = []
        packs[room].append((lengths, count))

    for length in sorted(histogram, reverse=True):
        left, grown = histogram[length], []
        while left:
            if free and -free[0] >= length:
                room = -free[0]
                lengths, count = packs[room].pop()
                used = min(left, count)
                if used < count:
                    packs[room].append((lengths, count - used))
                elif not packs[room]:
                    heapq.heappop(free)
                grown.append((lengths + (length,), used, room - length))
                left -= used
                if room - length >= length and left:
                    put(*grown.pop())
            else:
                fresh = capacity // length
                whole, rest = divmod(left, fresh)
                if whole:
                    grown.append(((length,) * fresh, whole, capacity - fresh * length))
                if rest:
                    grown.append(((length,) * rest, 1, capacity - rest * length))
                left = 0
        for g in grown:
            put(*g)
    return done + [p for ps in packs.values() for p in ps]


def encode_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                  capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, cache: int = CACHE) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, part, rank[, ids]): the pieces of every document.

    rank counts the pieces of equal length inside the task `part`. A worker keeps the ids of `cache` words.
    """
    fields = [(id_col, arrow_type(docs, id_col)), ("start", pa.int64()), ("length", pa.int64()),
              ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("part", pa.int32()), ("rank", pa.int64())]
    schema = pa.schema(fields + ([("ids", pa.binary())] if with_ids else []))

    def run(batches: Batches) -> Batches:
        part, ranks, enc = TaskContext.get().partitionId(), Counter(), encoder(tokenizer, cache)
        for b in batches:
            out = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = np.append(enc.encode(text), end_id).astype("<u4")
                for start in range(0, len(ids), capacity):
                    piece = ids[start:start + capacity]
                    raw = piece.tobytes()
                    row = (key, start, len(piece), zlib.crc32(raw), len(ids), part, ranks[len(piece)])
                    out.append((*row, raw) if with_ids else row)
                    ranks[len(piece)] += 1
            if out:
                yield batch(schema, *zip(*out, strict=True))

    return map_arrow(docs.select(id_col, text_or_empty(text_col).alias("_t")), run, schema)


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
         capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, cache: int = CACHE) -> DataFrame:
    """(id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]) of every piece.

    The driver holds the histogram, of at most `capacity` bins, and the patterns,
    whose number depends on the bins and not on the number of documents.
    """
    spark = docs.sparkSession
    pieces = stored(encode_pieces(docs, tokenizer, id_col, text_col, capacity, end_id, with_ids, cache))
    by_part = stored(pieces.groupBy("part", "length").agg(F.count("*").alias("n")))
    # Ranks: the pieces of equal length in earlier parts come first. A length has one row per part here.
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_part.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    full = histogram.pop(capacity, 0)
    slots, sequence, given = [], 0, Counter()
    if full:
        slots.append((capacity, 0, full, 0, 0))
        sequence = full
    for lengths, count in shortest_pack_first(histogram, capacity):
        offset = 0
        for length in lengths:
            slots.append((length, given[length], given[length] + count, sequence, offset))
            given[length] += count
            offset += length
        sequence += count
    table = spark.createDataFrame(slots, "length long, low long, high long, first long, offset long")
    placed = pieces.join(bases, ["part", "length"]).withColumn("rank", F.col("rank") + F.col("base")) \
        .join(F.broadcast(table), ["length"])
    placed = placed.where("rank >= low and rank < high") \
        .withColumn("sequence_id", F.col("first") + F.col("rank") - F.col("low"))
    return placed.select(id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset",
                         *(["ids"] if with_ids else []))
