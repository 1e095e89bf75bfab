"""Registered queries of the training-data operators: thin digests over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm import (
    ann, automata, fim, idfiles, langid, packing, pii, quality, resampling, simhash, suffixes, tiling, token_counts,
)
from triagelake.llm.common import crc_bucket, documents, settings
from triagelake.session import checkpoint_root

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def folder(spark: SparkSession, name: str) -> str:
    """A new folder in the shared store."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query
def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir))

    def count(kind: str):
        return F.size(F.filter("base", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, pii.KINDS), F.sha2(pii.joined_spans(F.col("base")), 256).alias("base_sha256"),
                        pii.joined_spans(pii.by_place(F.concat("base", "added"))).alias("spans"))


@query
def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(crc_bucket("doc_id", 5) == 0, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held_out)
    return quality.classify(documents(spark, sf_dir), labels).withColumn("held_out", held_out)


@query
def op3_token_id_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = folder(spark, "ids")
    idfiles.write_ids(documents(spark, sf_dir), path, public_tokenizers.path("word_bpe_49k.json"))
    return idfiles.read_documents(spark, path)


@query
def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


@query
def op5_nn_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings(spark)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return ann.neighbours(vectors, vectors.where(F.col("vec_id") % 100 == 0))


@query
def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.dedup(documents(spark, sf_dir))


@query
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held_out = F.coalesce(crc_bucket("doc_id", 4) == 2, F.lit(False))
    model = langid.fit(docs.where(~held_out).select("text", "lang"))
    return langid.identify(docs, model).withColumn("held_out", held_out)


@query
def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


@query
def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return automata.dedup(documents(spark, sf_dir))


@query
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query
def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fim.transform(documents(spark, sf_dir).select("doc_id", "text"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


ORACLES["op13_fill_in_middle"] = fim.ORACLE_SQL
