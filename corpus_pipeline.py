"""The corpus pipeline: from raw documents to packed training sequences.

Each stage gets what the stage before it wrote, and its decisions take effect.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm import langid, packing, pii, simhash, tiling
from triagelake.llm.common import documents, settings, stored

MIN_CONFIDENCE = 0.5
PIECES = 200_000      # pieces a worker of the last stage remembers; it still holds what the stages before left


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language: undetermined ones and those without a clear winner go."""
    settings(spark)
    model = langid.fit(docs.select("text", "lang"))
    named = langid.identify(docs, model, keep=tuple(c for c in docs.columns if c not in ("doc_id", "lang_pred", "score")))
    clear = (F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_CONFIDENCE)
    return named.where(clear).select("doc_id", "text", "lang", "source", "n_chars")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of SimHash near-duplicates."""
    settings(spark)
    return simhash.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that do not hold a benchmark item."""
    settings(spark)
    return tiling.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data and the terms that disclose it replaced."""
    settings(spark)
    return pii.sanitise(docs).withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the packed sequences."""
    settings(spark)
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), cache=PIECES)


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontamination", decontamination),
          ("pii", personal_data), ("packing", pack)]

#: SQL cannot express fingerprints, tiling or tokenisers; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written as Parquet and read again by the next."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir))
    return docs
