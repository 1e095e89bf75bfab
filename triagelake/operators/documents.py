"""Knowledge documents: ingest, upsert, chunks, embedding."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.functions import text
from triagelake.functions.evaluate import once
from triagelake.operators.keyed import latest_per_key

DOC_KEYS = ["source_type", "source_id"]


def page_documents(pages: DataFrame, base_url: str = "https://kb.local") -> DataFrame:
    """Pages to documents: tags become spaces, empty pages are skipped."""
    body = once(pages, {"content": text.strip_tags_spaced(F.col("html"))})
    return body.where(F.col("content") != "").select(
        F.lit("confluence").alias("source_type"), F.col("page_id").cast("string").alias("source_id"),
        F.concat(F.lit(f"{base_url}/pages/"), F.col("page_id")).alias("source_url"),
        F.coalesce(F.get(F.regexp_extract_all("html", F.lit(r"<title>([^<]*)</title>"), F.lit(1)),
                         F.lit(0)), F.lit("")).alias("title"), "content")


def runbook_documents(runbooks: DataFrame) -> DataFrame:
    """(title, content) seed rows; the source id is a slug of the title."""
    slug = F.substring(F.replace(F.lower("title"), F.lit(" "), F.lit("_")), 1, 40)
    return runbooks.select(F.lit("confluence").alias("source_type"), slug.alias("source_id"),
                           F.lit(None).cast("string").alias("source_url"), "title", "content")


def with_hash(docs: DataFrame) -> DataFrame:
    return docs.withColumn("content_hash", F.sha2("content", 256))


def document_upsert(log: DataFrame, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(documents, rejects) from a change log.

    The latest row per key wins. A content hash may belong to one key only: the
    row that came first in `order` keeps it (equal ones: the smallest key), the
    others are rejected. The owner of a hash comes
    from an aggregate, so copies are reduced map-side; joining it back splits
    under skew (AQE), because each hash has one owner row.
    """
    latest = with_hash(latest_per_key(log, DOC_KEYS, order))
    owner = latest.groupBy("content_hash").agg(
        F.min_by(F.struct(*DOC_KEYS), F.struct(*order, *DOC_KEYS)).alias("_owner"))
    j = latest.join(owner, "content_hash")
    mine = F.struct(*DOC_KEYS) == F.col("_owner")
    return (j.where(mine).drop("_owner"),
            j.where(~mine).select(*DOC_KEYS, "content_hash",
                                  F.col("_owner.source_id").alias("kept_source_id")))


def chunk_documents(docs: DataFrame, keys: list[str], content: str = "content", size: int = 400,
                    overlap: int = 50) -> DataFrame:
    """One row per chunk with its index and word count."""
    w = once(docs, {"_w": text.words(F.col(content))}, [*keys, content])
    c = w.select(*keys, F.size("_w").alias("_n"),
                 F.posexplode(text.chunks(F.col(content), F.col("_w"), size, overlap))
                 .alias("chunk_index", "chunk"))
    left = F.col("_n") - F.col("chunk_index") * (size - overlap)
    return c.withColumn("token_count", F.least(F.lit(size), left)).drop("_n")


def missing_chunks(docs: DataFrame, chunks: DataFrame, keys: list[str]) -> DataFrame:
    return docs.join(chunks.select(*keys), keys, "left_anti")


# ---- embedding ---------------------------------------------------------------

Embedder = Callable[[list[str]], "list[list[float] | None]"]


def embed_texts(df: DataFrame, text_col: str, embedder: Embedder, dim: int,
                out: str = "embedding", batch_size: int = 32) -> DataFrame:
    """Run an injected embedder over batches of texts inside the tasks.

    Blank texts, failed batches' texts and vectors of a wrong length become zero
    vectors; a failed batch is retried text by text, so one bad text costs only itself.
    """
    schema = df.withColumn(out, F.lit(None).cast("array<float>")).schema
    zero = [0.0] * dim

    def one(t: str) -> list[float]:
        try:
            v = embedder([t])[0]
            return list(v) if v is not None and len(v) == dim else zero
        except Exception:
            return zero

    def embed(batch: list[str]) -> list[list[float]]:
        try:
            got = embedder(batch)
            if len(got) == len(batch):
                return [list(v) if v is not None and len(v) == dim else zero for v in got]
        except Exception:
            pass
        return [one(t) for t in batch]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            texts = pdf[text_col].fillna("").str.strip()
            vectors: list = [zero] * len(pdf)
            filled = np.flatnonzero((texts != "").to_numpy())
            for at in range(0, len(filled), batch_size):
                idx = filled[at:at + batch_size]
                for i, v in zip(idx, embed([texts.iloc[j] for j in idx])):
                    vectors[i] = v
            pdf[out] = vectors
            yield pdf

    return df.mapInPandas(run, schema)


def hash_embedding(df: DataFrame, content: str, dim: int = 64, out: str = "embedding") -> DataFrame:
    """Built-in offline embedding: hashed word counts scaled to unit length.

    JVM-side (RegexTokenizer, HashingTF, Normalizer); a text without words gets
    the zero vector.
    """
    tok = RegexTokenizer(inputCol=content, outputCol="_tok", pattern=r"(?U)\W+")
    tf = HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=dim)
    nz = Normalizer(inputCol="_tf", outputCol="_unit", p=2.0)
    v = nz.transform(tf.transform(tok.transform(df)))
    return v.withColumn(out, vector_to_array("_unit")).drop("_tok", "_tf", "_unit")
