"""Knowledge-base search over chunk and article vectors."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions import scoring, text
from triagelake.functions.evaluate import once
from triagelake.functions.text import nullif_empty
from triagelake.functions.vectors import dot, unit
from triagelake.operators import blocks

TOP_K, MIN_SCORE, ATTACH_AT, EXCERPT = 5, 0.60, 0.80, 300     # fixed values


def vector_topk(queries: DataFrame, chunks: DataFrame, query_id: str, chunk_id: str,
                query_vec: str = "vec", chunk_vec: str = "vec", k: int = TOP_K,
                min_score: float = MIN_SCORE, source_type: str | None = None, **layout) -> DataFrame:
    """(query_id, chunk_id, score, rank): best chunks per query, score rounded to 4 digits.

    `layout` sets the size of a block and the number of pivots."""
    if source_type is not None:
        chunks = chunks.where(F.col("source_type") == source_type)
    hits = blocks.topk(blocks.prepare(queries, query_id, query_vec, "pid"),
                       blocks.prepare(chunks, chunk_id, chunk_vec, "cid"), k, min_score, **layout)
    return hits.select(F.col("pid").alias(query_id), F.col("cid").alias(chunk_id),
                       F.round("score", 4).alias("score"), "rank")


def query_text(title: Column, service: Column, classification: Column, summary: Column) -> Column:
    return F.concat_ws(" ", *[nullif_empty(c) for c in (title, service, classification, summary)])


def kb_hits(queries: DataFrame, hits: DataFrame, chunks: DataFrame, query_id: str, chunk_id: str,
            has_ticket: str) -> DataFrame:
    """Per query: hit count, best hit with its excerpt, attach flag. Queries without hits stay."""
    best = hits.where(F.col("rank") == 1).join(
        chunks.select(chunk_id, "title", F.substring("content", 1, EXCERPT).alias("excerpt")), chunk_id)
    counts = hits.groupBy(query_id).agg(F.count("*").alias("hits"))
    j = (queries.select(query_id, has_ticket).join(counts, query_id, "left")
                .join(best.select(query_id, chunk_id, "title", "excerpt", "score"), query_id, "left"))
    top = F.coalesce("score", F.lit(0.0))
    return j.select(query_id, F.coalesce("hits", F.lit(0)).alias("hits"),
                    F.col(chunk_id).alias("best_id"), "title", "excerpt", top.alias("top_score"),
                    ((top >= ATTACH_AT) & F.col(has_ticket)).alias("attached"))


def search_health(probes: DataFrame, chunks: DataFrame, query_id: str, chunk_id: str, k: int = 3,
                  min_score: float = 0.5) -> DataFrame:
    """Hits per probe query; probes with none are kept with zero."""
    hits = vector_topk(probes, chunks, query_id, chunk_id, k=k, min_score=min_score)
    per = hits.groupBy(query_id).agg(F.count("*").alias("hits"), F.max("score").alias("top_score"))
    return probes.select(query_id).join(per, query_id, "left").select(
        query_id, F.coalesce("hits", F.lit(0)).alias("hits"),
        F.coalesce("top_score", F.lit(0.0)).alias("top_score"))


# ---- keyword side -----------------------------------------------------------

def _equals(term: str):
    return lambda x: x == F.lit(term)


def dense_scores(df: DataFrame, id_col: str, vec_col: str, query: list[float]) -> DataFrame:
    """Cosine of every vector to one query vector (a literal)."""
    q = unit(F.array(*[F.lit(float(x)) for x in query]))
    return df.select(id_col, dot(unit(F.col(vec_col)), q).alias("score"))


def bm25(docs: DataFrame, doc_id: str, content: str, terms: list[str], k1: float = 1.2,
         b: float = 0.75) -> DataFrame:
    """BM25 of every document for one bag of query terms; documents without a term score 0.

    Term counts are taken per document from its own words, so nothing is
    exploded: one aggregate for the collection statistics, one row per document.
    """
    terms = sorted(set(t.lower() for t in terms))
    w = text.words(F.lower(F.regexp_replace(content, r"(?U)[^\w]+", " ")))
    tf = once(docs, {"_w": w}, [doc_id]).select(
        doc_id, F.size("_w").alias("_len"),
        *[F.size(F.filter("_w", _equals(t))).alias(f"_tf{i}") for i, t in enumerate(terms)])
    stats = tf.agg(F.count("*").alias("_docs"), F.avg("_len").alias("_avg"),
                   *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"_df{i}") for i in range(len(terms))])
    st = stats.first()                  # one row: two totals and a count per query term
    score = F.lit(0.0)
    for i in range(len(terms)):
        n, df_i = F.col(f"_tf{i}"), st[f"_df{i}"]
        idf = math.log(1 + (st["_docs"] - df_i + 0.5) / (df_i + 0.5))
        score = score + idf * n * (k1 + 1) / (n + k1 * (1 - b + b * F.col("_len") / F.lit(st["_avg"] or 1.0)))
    return tf.select(doc_id, score.alias("bm25"))


def recency(age_days: Column, half_life_days: float = 30.0) -> Column:
    return F.pow(F.lit(0.5), age_days / half_life_days)


def hybrid_search(dense: DataFrame, sparse: DataFrame, ages: DataFrame, doc_id: str, k: int) -> DataFrame:
    """0.6 cosine + 0.3 keyword score (scaled by the best one) + 0.1 recency; best k documents."""
    peak = F.lit(sparse.agg(F.max("bm25")).first()[0])
    j = sparse.join(dense, doc_id, "left").join(ages, doc_id, "left")
    total = scoring.hybrid(F.coalesce("score", F.lit(0.0)),
                           F.when(peak > 0, F.col("bm25") / peak).otherwise(0.0),
                           recency(F.col("age_days")))
    return (j.select(doc_id, F.round(total, 6).alias("final_score"))
             .orderBy(F.col("final_score").desc(), doc_id).limit(k))


# ---- synthesised articles ------------------------------------------------------

def article_search(incidents: DataFrame, articles: DataFrame, incident_id: str, k: int = 3,
                   min_score: float = 0.0) -> DataFrame:
    """Top active articles per incident with the tier bonus; low confidence stays hidden."""
    visible = articles.where(F.col("is_active") & (F.col("confidence") >= scoring.HIDE_BELOW))
    return vector_topk(incidents, visible, incident_id, "article_id", k=k, min_score=min_score
                       ).withColumn("tier_bonus", F.lit(scoring.TIER_BONUS))


def category_vote(incidents: DataFrame, articles: DataFrame, incident_id: str,
                  min_score: float = MIN_SCORE) -> DataFrame:
    """Category and team of the nearest active article, null when none is near."""
    hit = vector_topk(incidents, articles.where("is_active"), incident_id, "article_id", k=1,
                      min_score=min_score)
    labels = articles.select("article_id", "category", F.col("team").alias("voted_team"))
    return (incidents.select(incident_id).join(hit, incident_id, "left")
            .join(labels, "article_id", "left")
            .select(incident_id, "article_id", "category", "voted_team", "score"))


def nearest_article(candidates: DataFrame, articles: DataFrame, candidate_id: str,
                    min_score: float = scoring.REVIEW_AT) -> DataFrame:
    """Nearest active article at or above the review threshold; null when none."""
    near = blocks.topk(blocks.prepare(candidates, candidate_id, "vec", "pid"),
                       blocks.prepare(articles.where("is_active"), "article_id", "vec", "cid"),
                       1, min_score)
    near = near.select(F.col("pid").alias(candidate_id), F.col("cid").alias("article_id"),
                       F.col("score").alias("similarity"))
    return candidates.join(near, candidate_id, "left")


def stale_vectors(articles: DataFrame, current_version: str) -> DataFrame:
    return articles.where(~F.col("embedding_model_version").eqNullSafe(F.lit(current_version)))
