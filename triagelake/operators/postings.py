"""Keyword search for a table of queries over a table of postings.

Building counts the words of each document once: postings (term, doc, n) and the
documents' lengths, stored as Parquet. A table of queries is scored by joins.

The terms of up to BROADCAST_ROWS query rows go to every task, and postings are dealt by
document: all of a document's scores are summed where its postings are, and a task sends the
k best of each query. Larger tables of queries meet the postings by term. Common terms have
postings in a large share of all documents, so they are not joined with all of these:
candidates come from the other terms of a query, and its common terms are looked up for the
candidates only. That is exact where the k-th best candidate scores at least what the common
terms can give together; the few queries where it does not are scored with all of their terms.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.functions import scoring, text
from triagelake.functions.vectors import dot, unit
from triagelake.operators.keyed import top_per_key
from triagelake.operators.search import recency
from triagelake.session import cut_counted, cut_lineage

K1, B = 1.2, 0.75
COMMON = 0.1                # share of documents from which a term is common
BROADCAST_ROWS = 200_000    # (query, term) rows that are sent to every task


@dataclass
class Postings:
    """postings (term, doc, n) and lengths (doc, length) under a path."""

    spark: SparkSession
    path: str

    @property
    def postings(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/postings")

    @property
    def lengths(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/lengths")


def terms(content: Column) -> Column:
    """Lower-case words; everything else parts them."""
    return text.words(F.lower(F.regexp_replace(content, r"(?U)[^\w]+", " ")))


def build(docs: DataFrame, doc_id: str, content: str, path: str) -> Postings:
    words = docs.select(F.col(doc_id).alias("doc"), terms(F.coalesce(content, F.lit(""))).alias("w"))
    words.select("doc", F.size("w").alias("length")).write.parquet(f"{path}/lengths")
    counts = words.select("doc", F.explode("w").alias("term")).groupBy("term", "doc").agg(F.count("*").alias("n"))
    # A term's rows lie together in each file; counting has dealt the rows already.
    counts.sortWithinPartitions("term", "doc").write.parquet(f"{path}/postings")
    return Postings(docs.sparkSession, path)


def _weights(index: Postings, queries: DataFrame, query_id: str, content: str) -> DataFrame:
    """(query, term, idf, common) of the distinct terms of each query that some document has."""
    asked = queries.select(F.col(query_id).alias("query"), F.explode(F.array_distinct(terms(content))).alias("term"))
    held = index.postings.join(asked.select("term").distinct(), "term").groupBy("term").agg(F.count("*").alias("df"))
    docs = index.lengths.agg(F.count("*").cast("double")).scalar()
    idf = F.log(1 + (docs - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return asked.join(held, "term").select("query", "term", idf.alias("idf"), (F.col("df") > COMMON * docs).alias("common"))


def _part(index: Postings) -> Column:
    """Score of one (term, doc) with idf, n and length."""
    mean = index.lengths.agg(F.coalesce(F.nullif(F.avg("length"), F.lit(0.0)), F.lit(1.0))).scalar()
    return F.col("idf") * F.col("n") * (K1 + 1) / (F.col("n") + K1 * (1 - B + B * F.col("length") / mean))


def _scored(index: Postings, weights: DataFrame) -> DataFrame:
    """(query, doc, score) over the given terms of the queries."""
    hits = weights.join(index.postings, "term").join(index.lengths, "doc")
    return hits.withColumn("part", _part(index)).groupBy("query", "doc").agg(F.sum("part").alias("score"))


def _scored_by_document(index: Postings, weights: DataFrame) -> DataFrame:
    """The same for few weights: rows of a document stay in their task."""
    asked = index.postings.join(F.broadcast(weights.select("term").distinct()), "term", "left_semi").repartition("doc")
    hits = asked.join(index.lengths.repartition("doc"), "doc").join(F.broadcast(weights), "term")
    return hits.withColumn("part", _part(index)).groupBy("query", "doc").agg(F.sum("part").alias("score"))


def _best(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query. Scores are rounded first, so that the order of a sum decides no tie."""
    return top_per_key(scored.withColumn("score", F.round("score", 9)), ["query"], [F.col("score").desc(), F.col("doc")], k)


def scores(index: Postings, queries: DataFrame, query_id: str, content: str, k: int) -> DataFrame:
    """(query, doc, score, rank): the k best documents with a term of each query; ties to the smaller document."""
    weights, seen = cut_counted(_weights(index, queries, query_id, content), n=F.count(F.lit(1)))
    if seen["n"] <= BROADCAST_ROWS:
        # Stored, since rows and peaks are both taken from it.
        return cut_lineage(_best(_scored_by_document(index, weights), k))
    rare, common = weights.where(~F.col("common")), weights.where("common")
    candidates = _scored(index, rare)
    # Common terms of a query, for its candidates only.
    looked_up = candidates.select("query", "doc").join(common, "query").join(index.postings, ["term", "doc"]) \
        .join(index.lengths, "doc").withColumn("part", _part(index)).groupBy("query", "doc").agg(F.sum("part").alias("more"))
    full = candidates.join(looked_up, ["query", "doc"], "left").select(
        "query", "doc", (F.col("score") + F.coalesce("more", F.lit(0.0))).alias("score"))
    best = cut_lineage(_best(full, k))
    # A document with common terms only scores less than this.
    most = common.groupBy("query").agg((F.sum("idf") * (K1 + 1)).alias("most"))
    reached = best.where(F.col("rank") == k).select("query", F.col("score").alias("least"))
    unsure = most.join(reached, "query", "left").where(F.col("least").isNull() | (F.col("least") < F.col("most"))).select("query")
    again = _best(_scored(index, weights.join(unsure, "query")), k)
    return best.join(unsure, "query", "left_anti").unionByName(again)


def hybrid(index: Postings, queries: DataFrame, docs: DataFrame, query_id: str, content: str, vec: str, k: int,
           candidates: int) -> DataFrame:
    """(query, doc, final_score, rank): the `candidates` best by keywords of each query, reranked.

    0.6 cosine + 0.3 keyword score, scaled by the query's best, + 0.1 recency. `docs` has doc, vec, age_days."""
    found = scores(index, queries, query_id, content, candidates)
    peak = found.where("rank = 1").select("query", F.col("score").alias("peak"))
    own = queries.select(F.col(query_id).alias("query"), unit(F.col(vec)).alias("q"))
    seen = docs.select("doc", unit(F.col("vec")).alias("u"), "age_days")
    j = found.drop("rank").join(peak, "query").join(own, "query").join(seen, "doc", "left")
    total = scoring.hybrid(F.coalesce(dot(F.col("q"), F.col("u")), F.lit(0.0)), F.col("score") / F.col("peak"),
                           F.coalesce(recency(F.col("age_days")), F.lit(0.0)))
    return top_per_key(j.select("query", "doc", F.round(total, 6).alias("final_score")), ["query"],
                       [F.col("final_score").desc(), F.col("doc")], k)
