"""Small helpers of the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_type

from triagelake.session import checkpoint_root

Batches = Iterator[pa.RecordBatch]


def settings(spark: SparkSession) -> None:
    """Batches to Python stay small in bytes, however long the texts are."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2048")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame, *by: str) -> DataFrame:
    """df written to the shared folder, in folders of `by`, and read back: computed once, safe from lost executors."""
    path = f"{checkpoint_root(df.sparkSession).rstrip('/')}/llm-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_key(text: Column) -> Column:
    """16 bytes that stand for a text: 128 bits of its SHA-256, so that no two texts share them."""
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


@contextmanager
def distinct_texts(docs: DataFrame, text_col: str):
    """(k, t, n) of the distinct texts as bytes with their numbers of rows, in buckets of k; dropped at the end.

    The joins with texts that follow move no text. A copy of a text meets the
    others in the map-side aggregate.
    """
    spark, name = docs.sparkSession, f"texts_{uuid.uuid4().hex}"
    rows = docs.select(text_bytes(text_col).alias("t")).select(text_key(F.col("t")).alias("k"), "t")
    rows.groupBy("k").agg(F.first("t").alias("t"), F.count("*").alias("n")).write.option("compression", "zstd").bucketBy(
        shuffle_partitions(spark), "k").saveAsTable(name)
    try:
        yield spark.table(name).select("k", "t", "n")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names with as many underscores behind them as it takes to differ from all columns."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def arrow_type(df: DataFrame, col: str) -> pa.DataType:
    return to_arrow_type(df.schema[col].dataType)


def map_arrow(df: DataFrame, fn: Callable[[Batches], Batches], schema: pa.Schema) -> DataFrame:
    return df.mapInArrow(fn, from_arrow_schema(schema))


def text_bytes(col: str) -> Column:
    """UTF-8 bytes of a text; null is the empty text."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def text_or_empty(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    arrays = [c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


def crc_bucket(key: str, buckets: int) -> Column:
    """crc32 of the key as text, modulo `buckets`; the fixed split of rows into learned and held out."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % buckets
