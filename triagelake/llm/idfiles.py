"""Token ids as bit-plane or byte-plane shuffled, compressed chunks with an index.

Chunk format. Ids are cut into blocks of `block` ids. A block is transposed into
planes: byte plane k holds byte k of each id, bit plane k holds bit k of each id,
eight ids to a byte. Planes above the highest bit in use are left out. Each plane
is one zstandard frame. A payload is the frames of all blocks, one after another.
The index row of a chunk has its place, the documents in it with their numbers of
ids, the number of planes and the length of each frame; it can be read without
the payloads. A document never crosses a chunk, so any chunk decodes alone.

Chunks are written by Spark's Parquet writer into any store Spark can write:
failed tasks leave nothing behind.

Rows: a null or empty text is the end id alone. Null document ids come first.
Equal document ids follow one another in the order of a hash of their texts.
Other columns are not read. An empty table gives an empty store.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from triagelake.llm.common import Batches, arrow_type, batch, map_arrow, shuffle_partitions, text_or_empty
from triagelake.llm.tokens import encoder

END_ID = 2
BLOCK = 1 << 16
CHUNK_IDS = 1 << 18           # a chunk is closed by the document that reaches this many ids
PLANES = ("byte", "bit")


def split_planes(ids: np.ndarray, kind: str) -> list[bytes]:
    """Planes of one block, lowest first."""
    top = int(ids.max()).bit_length() if len(ids) else 0
    if kind == "byte":
        matrix = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
        return [matrix[:, k].tobytes() for k in range((top + 7) // 8)]
    return [np.packbits((ids >> k & 1).astype(np.uint8), bitorder="little").tobytes() for k in range(top)]


def join_planes(planes: list[bytes], n: int, kind: str) -> np.ndarray:
    out = np.zeros(n, "<u4")
    for k, p in enumerate(planes):
        if kind == "byte":
            out |= np.frombuffer(p, np.uint8).astype("<u4") << np.uint32(8 * k)
        else:
            bits = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
            out |= bits.astype("<u4") << np.uint32(k)
    return out


def compress(ids: np.ndarray, kind: str, block: int, level: int) -> tuple[bytes, list[int], list[int]]:
    """(payload, planes of each block, bytes of each frame)."""
    press, frames, planes = zstandard.ZstdCompressor(level=level), [], []
    for i in range(0, len(ids), block):
        parts = split_planes(ids[i:i + block], kind)
        planes.append(len(parts))
        frames += [press.compress(p) for p in parts]
    return b"".join(frames), planes, [len(f) for f in frames]


def decompress(payload: bytes, n: int, planes: list[int], frames: list[int], kind: str, block: int) -> np.ndarray:
    press, out, at, frame = zstandard.ZstdDecompressor(), [], 0, 0
    for b, count in enumerate(planes):
        parts = []
        for size in frames[frame:frame + count]:
            parts.append(press.decompress(payload[at:at + size]))
            at += size
        frame += count
        out.append(join_planes(parts, min(block, n - b * block), kind))
    return np.concatenate(out) if out else np.zeros(0, "<u4")


def write_ids(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
              end_id: int = END_ID, kind: str = "byte", block: int = BLOCK, chunk_ids: int = CHUNK_IDS,
              level: int = 3) -> None:
    """Write the ids of all documents, in ascending order of id, to `path`."""
    if kind not in PLANES:
        raise ValueError(f"planes are {PLANES}")
    schema = pa.schema([("part", pa.int32()), ("chunk", pa.int32()), ("local_start", pa.int64()),
                        ("n_ids", pa.int64()), ("doc_ids", pa.list_(arrow_type(docs, id_col))),
                        ("doc_lens", pa.list_(pa.int64())), ("kind", pa.string()), ("block", pa.int32()),
                        ("planes", pa.list_(pa.int32())), ("frames", pa.list_(pa.int32())),
                        ("ids_crc32", pa.int64()), ("payload", pa.binary())])

    def run(batches: Batches) -> Batches:
        part, enc, chunk, start = TaskContext.get().partitionId(), encoder(tokenizer), 0, 0
        keys, lens, ids, total = [], [], [], 0

        def close() -> pa.RecordBatch:
            all_ids = np.concatenate(ids)
            payload, planes, frames = compress(all_ids, kind, block, level)
            return batch(schema, [part], [chunk], [start], [total], [keys], [lens], [kind], [block], [planes],
                         [frames], [zlib.crc32(all_ids.tobytes())], [payload])

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                one = np.append(enc.encode(text), end_id).astype("<u4")
                keys.append(key), lens.append(len(one)), ids.append(one)
                total += len(one)
                if total >= chunk_ids:
                    yield close()
                    chunk, start = chunk + 1, start + total
                    keys, lens, ids, total = [], [], [], 0
        if keys:
            yield close()

    ordered = docs.select(id_col, text_or_empty(text_col).alias("_t")) \
        .repartitionByRange(shuffle_partitions(docs.sparkSession), F.col(id_col), F.xxhash64("_t")) \
        .sortWithinPartitions(F.col(id_col), F.xxhash64("_t"))
    map_arrow(ordered, run, schema).write.option("compression", "uncompressed").parquet(path)


def _with_starts(chunks: DataFrame) -> DataFrame:
    # One row for each part, so as few as the writer had tasks.
    totals = chunks.groupBy("part").agg(F.sum("n_ids").alias("_n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return chunks.join(F.broadcast(offsets), "part") \
        .withColumn("start", F.col("_before") + F.col("local_start")).drop("_before")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The chunk index with each chunk's global start."""
    return _with_starts(spark.read.parquet(path).drop("payload"))


def read_documents(spark: SparkSession, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, decoded from the files."""
    chunks = _with_starts(spark.read.parquet(path))
    key = pa.list_(arrow_type(chunks, "doc_ids").value_type)
    fields = [("doc_id", key.value_type), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    schema = pa.schema(fields + ([("ids", pa.binary())] if with_ids else []))

    def run(batches: Batches) -> Batches:
        for b in batches:
            for c in b.to_pylist():
                ids = decompress(c["payload"], c["n_ids"], c["planes"], c["frames"], c["kind"], c["block"])
                if zlib.crc32(ids.tobytes()) != c["ids_crc32"]:
                    raise ValueError(f"chunk {c['part']}/{c['chunk']} is damaged")
                ends = np.cumsum(c["doc_lens"])
                raw = [p.tobytes() for p in np.split(ids, ends[:-1])]
                cols = [c["doc_ids"], c["start"] + ends - c["doc_lens"], c["doc_lens"], [zlib.crc32(r) for r in raw]]
                yield batch(schema, *cols, *([raw] if with_ids else []))

    return map_arrow(chunks, run, schema)
