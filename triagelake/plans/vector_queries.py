"""Queries: vector search, clustering measures, density clustering."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake.functions.vectors import unit
from triagelake.operators import blocks, clusters, density, ivf, postings, search
from triagelake.plans import sqltext as S
from triagelake.plans.registry import ORACLES, query
from triagelake.session import scratch
from triagelake.sources import domain as D


def members(spark, sf):
    """Labels as clusters: (cluster, team, number, u)."""
    v = D.team_vectors(spark, sf)
    return v.select(F.col("label").alias("cluster"), "team", "number", unit(F.col("vec")).alias("u"))


@query(f"""WITH {S.VEC}, p AS (SELECT a.number AS query_id, b.number AS chunk_id, {S.cos('a.vec', 'b.vec')} AS s FROM vec a, vec b)
  SELECT query_id, chunk_id, round(s, 4) AS score, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id
  ORDER BY s DESC, chunk_id) AS rn FROM p WHERE s >= 0.60) WHERE rn <= 5""")
def vector_topk(spark, sf):
    v = D.team_vectors(spark, sf)
    return search.vector_topk(v.select(F.col("number").alias("query_id"), "vec"),
                              v.select(F.col("number").alias("chunk_id"), "vec"), "query_id", "chunk_id")


@query(ORACLES["vector_topk"])
def vector_topk_cells(spark, sf):
    """The same by pruned cells: small blocks and few pivots, so that small tables take the partitioned path."""
    v = D.team_vectors(spark, sf)
    return search.vector_topk(v.select(F.col("number").alias("query_id"), "vec"),
                              v.select(F.col("number").alias("chunk_id"), "vec"), "query_id", "chunk_id",
                              block=64, pivots=12)


@query(f"""WITH {S.VEC}, p AS (SELECT a.number AS query_id, b.number AS chunk_id, {S.cos('a.vec', 'b.vec')} AS s FROM vec a, vec b)
  SELECT query_id, chunk_id, round(s, 4) AS score, CAST(rn AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id
  ORDER BY s DESC, chunk_id) AS rn FROM p WHERE s >= 0.80) WHERE rn <= 3""")
def near_matches_cells(spark, sf):
    """Close matches by pruned cells with a narrow reach."""
    v = D.team_vectors(spark, sf)
    return search.vector_topk(v.select(F.col("number").alias("query_id"), "vec"),
                              v.select(F.col("number").alias("chunk_id"), "vec"), "query_id",
                              "chunk_id", k=3, min_score=0.8, block=32, pivots=12)


@query(f"""WITH {S.VEC}, {S.ART}, p AS (SELECT a.number AS query_id, label_b, {S.cos('a.vec', 'b.vec')} AS s, article_id
    FROM vec a, (SELECT *, label AS label_b FROM art) b WHERE b.category = 'cat1')
  SELECT query_id, article_id, round(s, 4) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, article_id) AS rn
  FROM p WHERE s >= 0.0) WHERE rn <= 2""")
def vector_topk_by_source(spark, sf):
    """Restricted to one source type, no minimum score."""
    a = D.existing_articles(spark, sf).withColumn("source_type", F.col("category"))
    v = D.team_vectors(spark, sf).select(F.col("number").alias("query_id"), "vec")
    return search.vector_topk(v, a, "query_id", "article_id", k=2, min_score=0.0, source_type="cat1").drop("rank")


def _ivf(spark, sf, cells=None, visits=None):
    v = D.team_vectors(spark, sf)
    index = ivf.build(blocks.prepare(v, "number", "vec", "cid"), scratch(spark, "ivf"), cells)
    hits = ivf.search(index, blocks.prepare(v, "number", "vec", "pid"), search.TOP_K, search.MIN_SCORE, visits)
    return hits.select(F.col("pid").alias("query_id"), F.col("cid").alias("chunk_id"), F.round("score", 4).alias("score"), "rank")


@query(ORACLES["vector_topk"])
def vector_topk_ivf_all(spark, sf):
    """The inverted file with as many visits as cells: exact."""
    return _ivf(spark, sf, cells=12, visits=12)


@query()
def vector_topk_ivf(spark, sf):
    """The inverted file as it is used: the nearest cells only."""
    return _ivf(spark, sf)


@query(f"""WITH {S.VEC}, {S.ART}, p AS (SELECT a.number, a.label % 2 = 0 AS has_ticket, article_id, round({S.cos('a.vec', 'b.vec')}, 4) AS score,
    {S.cos('a.vec', 'b.vec')} AS s FROM vec a, art b),
  h AS (SELECT *, row_number() OVER (PARTITION BY number ORDER BY s DESC, article_id) AS rn, count(*) OVER (PARTITION BY number) AS hits
    FROM p WHERE s >= 0.60)
  SELECT vec.number, least(coalesce(hits, 0), 5) AS hits, article_id AS best_id, 'Title ' || article_id AS title,
    left('Content of ' || article_id || repeat(' and more', 60), 300) AS excerpt, coalesce(score, 0.0::DOUBLE) AS top_score,
    coalesce(score, 0.0) >= 0.80 AND vec.label % 2 = 0 AS attached FROM vec LEFT JOIN h ON vec.number = h.number AND rn = 1""")
def kb_hits(spark, sf):
    v = D.team_vectors(spark, sf).select("number", "vec", (F.col("label") % 2 == 0).alias("has_ticket"))
    a = D.existing_articles(spark, sf).withColumns({
        "title": F.concat(F.lit("Title "), "article_id"),
        "content": F.concat(F.lit("Content of "), "article_id", F.repeat(F.lit(" and more"), 60))})
    hits = search.vector_topk(v, a, "number", "article_id")
    return search.kb_hits(v, hits, a, "number", "article_id", "has_ticket")


@query(f"""WITH {S.INC} SELECT external_id, concat_ws(' ', nullif(external_id, ''), nullif(service, ''),
  CASE WHEN flow = 'primary' THEN severity END) AS query_text FROM inc""")
def kb_query_text(spark, sf):
    i = D.incidents(spark, sf)
    return i.select("external_id", search.query_text(
        F.col("external_id"), F.col("service"), F.when(F.col("flow") == "primary", F.col("severity")).otherwise(""),
        F.lit(None).cast("string")).alias("query_text"))


@query(f"""WITH {S.VEC}, {S.ART}, p AS (SELECT article_id, round({S.cos('a.vec', 'b.vec')}, 4) AS score FROM art a, vec b
    WHERE {S.cos('a.vec', 'b.vec')} >= 0.93)
  SELECT article_id, least(count(score), 3) AS hits, coalesce(max(score), 0.0) AS top_score FROM art LEFT JOIN p USING (article_id) GROUP BY 1""")
def search_health(spark, sf):
    """Articles probe the incident vectors; the high threshold leaves some without a hit."""
    v = D.team_vectors(spark, sf).select(F.col("number").alias("chunk_id"), "vec")
    return search.search_health(D.existing_articles(spark, sf), v, "article_id", "chunk_id", 3, 0.93)


TERMS = ["the", "of", "restart", "le", "und", "thereou"]
_BM_WORDS = S.words(r"lower(regexp_replace(text, '[^\w\x{80}-\x{10FFFF}]+', ' ', 'g'))")


def _bm25_sql(cols: str) -> str:
    terms = ", ".join(f"('{t}')" for t in TERMS)
    return f"""w AS (SELECT doc_id, {_BM_WORDS} AS w FROM documents), t(term) AS (VALUES {terms}),
  tf AS (SELECT doc_id, term, len(w) AS dl, len(list_filter(w, lambda x: x = term)) AS n FROM w, t),
  st AS (SELECT count(*) AS docs, avg(len(w)) AS avgdl FROM w), df AS (SELECT term, count(*) FILTER (n > 0) AS df FROM tf GROUP BY 1),
  bm AS (SELECT doc_id, sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS bm25
    FROM tf JOIN df USING (term), st GROUP BY 1) {cols}"""


@query("WITH " + _bm25_sql("SELECT doc_id, round(bm25, 6) AS bm25 FROM bm"))
def bm25_scores(spark, sf):
    d = D.table(spark, sf, "documents").select("doc_id", "text")
    return search.bm25(d, "doc_id", "text", TERMS).select("doc_id", F.round("bm25", 6).alias("bm25"))


@query("WITH " + _bm25_sql("") + f""", {S.VEC}, {S.ART}, q AS (SELECT vec FROM art WHERE article_id = 'art-0'),
  dn AS (SELECT vec_id AS doc_id, list_cosine_similarity(vec.vec, q.vec) AS score FROM vec, q)
  SELECT doc_id, round(0.6 * coalesce(score, 0) + 0.3 * bm25 / (SELECT max(bm25) FROM bm)
    + 0.1 * pow(0.5, (doc_id % 90) / 30.0), 6) AS final_score FROM bm LEFT JOIN dn USING (doc_id)
  ORDER BY final_score DESC, doc_id LIMIT 20""")
def hybrid_search(spark, sf):
    d = D.table(spark, sf, "documents").select("doc_id", "text")
    q = D.existing_articles(spark, sf).where(F.col("article_id") == "art-0").first()["vec"]
    dense = search.dense_scores(D.team_vectors(spark, sf).withColumnRenamed("vec_id", "doc_id"),
                                "doc_id", "vec", q)
    ages = d.select("doc_id", (F.col("doc_id") % 90).alias("age_days"))
    return search.hybrid_search(dense, search.bm25(d, "doc_id", "text", TERMS), ages, "doc_id", 20)


_MANY = f"""dw AS (SELECT doc_id AS doc, {_BM_WORDS} AS w FROM documents), qw AS (SELECT item_id AS query, {_BM_WORDS} AS w FROM benchmark),
  asked AS (SELECT DISTINCT query, unnest(w) AS term FROM qw),
  post AS (SELECT term, doc, count(*) AS n FROM (SELECT doc, unnest(w) AS term FROM dw) GROUP BY ALL),
  st AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM dw), df AS (SELECT term, count(*) AS df FROM post GROUP BY 1),
  found AS (SELECT query, doc, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(w) / mean))), 9) AS score
    FROM asked JOIN post USING (term) JOIN df USING (term) JOIN dw USING (doc), st GROUP BY query, doc),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rn FROM found)"""


def _keyword_index(spark, sf):
    return postings.build(D.table(spark, sf, "documents").select("doc_id", "text"), "doc_id", "text", scratch(spark, "postings"))


@query(f"WITH {_MANY} SELECT query, doc, round(score, 6) AS score, CAST(rn AS INT) AS rank FROM ranked WHERE rn <= 10")
def bm25_table(spark, sf):
    """Every benchmark item as a query against all documents, by postings."""
    hits = postings.scores(_keyword_index(spark, sf), D.table(spark, sf, "benchmark"), "item_id", "text", 10)
    return hits.withColumn("score", F.round("score", 6))


@query(f"""WITH {_MANY}, {S.VEC}, near AS (SELECT *, max(score) OVER (PARTITION BY query) AS peak FROM ranked WHERE rn <= 30),
  t AS (SELECT query, doc, round(0.6 * coalesce(list_cosine_similarity(d.vec, q.vec), 0) + 0.3 * score / peak + 0.1 * pow(0.5, (doc % 90) / 30.0), 6) AS final_score
    FROM near LEFT JOIN vec d ON d.vec_id = doc LEFT JOIN vec q ON q.vec_id = query)
  SELECT *, CAST(row_number() OVER (PARTITION BY query ORDER BY final_score DESC, doc) AS INT) AS rank FROM t QUALIFY rank <= 5""")
def hybrid_search_table(spark, sf):
    """The 30 best documents of every benchmark item by keywords, reranked with vectors and age."""
    v = D.team_vectors(spark, sf).select(F.col("vec_id").alias("id"), "vec")
    asked = D.table(spark, sf, "benchmark").join(v, F.col("item_id") == F.col("id"), "left").select("item_id", "text", "vec")
    docs = D.table(spark, sf, "documents").select(F.col("doc_id").alias("doc")).join(
        v, F.col("doc") == F.col("id"), "left").select("doc", "vec", (F.col("doc") % 90).alias("age_days"))
    return postings.hybrid(_keyword_index(spark, sf), asked, docs, "item_id", "text", "vec", 5, 30)


@query(f"""WITH {S.VEC}, {S.ART}, p AS (SELECT number, article_id, {S.cos('a.vec', 'b.vec')} AS s FROM vec a, art b
    WHERE is_active AND confidence >= 0.40)
  SELECT number, article_id, round(s, 4) AS score, CAST(rn AS INT) AS rank, 0.8::DOUBLE AS tier_bonus FROM (SELECT *, row_number() OVER (
  PARTITION BY number ORDER BY s DESC, article_id) AS rn FROM p WHERE s >= 0.5) WHERE rn <= 3""")
def kb_tier_search(spark, sf):
    v = D.team_vectors(spark, sf)
    return search.article_search(v, D.existing_articles(spark, sf), "number", min_score=0.5)


@query(f"""WITH {S.VEC}, {S.ART}, p AS (SELECT number, article_id, category, b.team AS voted_team, {S.cos('a.vec', 'b.vec')} AS s
    FROM vec a, art b WHERE is_active),
  h AS (SELECT * FROM p WHERE s >= 0.60 QUALIFY row_number() OVER (PARTITION BY number ORDER BY s DESC, article_id) = 1)
  SELECT vec.number, article_id, category, voted_team, round(s, 4) AS score FROM vec LEFT JOIN h USING (number)""")
def category_vote(spark, sf):
    return search.category_vote(D.team_vectors(spark, sf), D.existing_articles(spark, sf), "number")


# ---- clusters ------------------------------------------------------------------

@query(f"""WITH {S.VEC} SELECT a.label AS cluster, count(DISTINCT a.number) AS n, round(median({S.cos('a.vec', 'b.vec')}), 6) AS cohesion
  FROM vec a JOIN vec b ON a.label = b.label AND a.number < b.number GROUP BY 1""".replace(
      "count(DISTINCT a.number)", "count(DISTINCT a.number) + 1"))
def cluster_cohesion(spark, sf):
    return clusters.cohesion(members(spark, sf)).select("cluster", "n", F.round("cohesion", 6).alias("cohesion"))


_MEDOID = f"""md AS (SELECT cluster, number AS medoid FROM (SELECT a.label AS cluster, a.number, row_number() OVER (PARTITION BY a.label
  ORDER BY round(sum(1 - list_cosine_similarity(a.vec, b.vec)), 9), a.number) AS rn
  FROM vec a JOIN vec b ON a.label = b.label GROUP BY 1, 2) WHERE rn = 1)"""


@query(f"WITH {S.VEC}, {_MEDOID} SELECT cluster, medoid FROM md")
def cluster_medoid(spark, sf):
    return clusters.medoids(members(spark, sf))


@query("""WITH m AS (SELECT label AS cluster, printf('N%06d', vec_id) AS number FROM embeddings)
  SELECT cluster, 'team' || cluster || '_' || left(sha1('team' || cluster || ':' || string_agg(number, ',' ORDER BY number)), 12) AS signature
  FROM m GROUP BY 1""")
def cluster_signature(spark, sf):
    v = D.table(spark, sf, "embeddings").select(
        F.col("label").alias("cluster"), F.concat(F.lit("team"), "label").alias("team"),
        F.format_string("N%06d", F.col("vec_id")).alias("number"))
    return clusters.signatures(v)


@query(f"""WITH {S.VEC}, f AS (SELECT *, CASE WHEN label < 6 THEN label ELSE 6 + label % 2 END AS cluster FROM vec)
  SELECT cluster, n FROM (SELECT a.cluster, count(DISTINCT a.number) + 1 AS n, median({S.cos('a.vec', 'b.vec')}) AS c
    FROM f a JOIN f b ON a.cluster = b.cluster AND a.number < b.number GROUP BY 1) WHERE c >= 0.65 AND n >= 2""")
def cluster_gate(spark, sf):
    """The last four labels folded into two clusters: the mixed ones fail the gate, the pure ones pass."""
    fold = F.when(F.col("label") < 6, F.col("label")).otherwise(6 + F.col("label") % 2)
    m = D.team_vectors(spark, sf).select(fold.alias("cluster"), "number", unit(F.col("vec")).alias("u"))
    return clusters.quality_gate(clusters.cohesion(m)).select("cluster", "n")




def _dated(spark, sf):
    v = D.team_vectors(spark, sf)
    return v.select(F.col("label").alias("cluster"), "team", "number", unit(F.col("vec")).alias("u"),
                    F.date_add(F.lit("2024-01-01").cast("date"),
                               ((F.col("vec_id") * 97 * (F.col("label") + 1)) % (30 + 10 * F.col("label")))
                               .cast("int")).alias("closed_at"))


@query("""SELECT label AS cluster, CAST(max(d) - min(d) AS INT) AS days, count(*) AS n, max(d) - min(d) <= 60 AS kept FROM (SELECT label,
  CAST((vec_id * 97 * (label + 1)) % (30 + 10 * label) AS INT) AS d FROM embeddings) GROUP BY 1""")
def cluster_spread(spark, sf):
    return clusters.spread_days(_dated(spark, sf), "closed_at")


@query(f"""WITH {S.VEC}, d AS (SELECT a.label, a.number, b.label AS ol, avg(1 - list_cosine_similarity(a.vec, b.vec)) AS m,
    sum(1 - list_cosine_similarity(a.vec, b.vec)) AS s, count(*) AS n FROM vec a JOIN vec b ON a.label % 2 = b.label % 2 GROUP BY 1, 2, 3),
  ab AS (SELECT label, number, max(CASE WHEN ol = label THEN s / (n - 1) END) AS a, min(CASE WHEN ol <> label THEN m END) AS b FROM d GROUP BY 1, 2)
  SELECT label AS cluster, round(avg((b - a) / greatest(a, b)), 6) AS silhouette FROM ab GROUP BY 1""")
def cluster_silhouette(spark, sf):
    """Labels as clusters, two groups of labels as teams."""
    v = D.team_vectors(spark, sf)
    m = v.select(F.col("label").alias("cluster"), (F.col("label") % 2).alias("half"), "number",
                 unit(F.col("vec")).alias("u"))
    return clusters.silhouette(m, "half")


@query(f"""WITH {S.VEC}, {_MEDOID} SELECT cluster, number, sim, CAST(rn AS INT) AS rank FROM (SELECT cluster, v.number,
    round(list_cosine_similarity(v.vec, m.vec), 6) AS sim, row_number() OVER (PARTITION BY cluster ORDER BY v.number = medoid DESC,
    round(list_cosine_similarity(v.vec, m.vec), 9) DESC, v.number) AS rn FROM md JOIN vec m ON m.number = medoid JOIN vec v ON v.label = cluster)
  WHERE rn <= 5""")
def cluster_representatives(spark, sf):
    m = members(spark, sf)
    r = clusters.representatives(m, clusters.medoids(m))
    return r.select("cluster", "number", F.round("sim", 6).alias("sim"), "rank")


@query(f"""WITH {S.VEC}, {_MEDOID} SELECT cluster, v.number FROM md JOIN vec m ON m.number = medoid JOIN vec v ON v.label = cluster
  WHERE 1 - round(list_cosine_similarity(v.vec, m.vec), 9) <= 0.08""")
def cluster_outliers(spark, sf):
    """Members near the medoid; 0.08 instead of 0.4, since planted clusters are tight."""
    m = members(spark, sf)
    return clusters.drop_outliers(m, clusters.medoids(m), 0.08).select("cluster", "number")


# ---- density clustering ----------------------------------------------------------

def team_units(spark, sf):
    """Two labels per team, so that every team holds two dense groups."""
    v = D.team_vectors(spark, sf).withColumn("half", F.concat(F.lit("team"), F.floor(F.col("label") / 2)))
    return blocks.prepare(v, "number", "vec", "cid", "half")


_HALF = f"""{S.VEC}, h AS (SELECT 'team' || (label // 2) AS grp, number, vec FROM vec),
  dist AS (SELECT a.grp, a.number AS a, b.number AS b, round(1 - {S.cos('a.vec', 'b.vec')}, 12) AS d FROM h a JOIN h b
    ON a.grp = b.grp AND a.number <> b.number),
  core AS (SELECT grp, a AS number, d AS core FROM dist QUALIFY row_number() OVER (PARTITION BY grp, a ORDER BY d) = 3)"""


@query(f"WITH {_HALF} SELECT grp, number, round(core, 9) AS core FROM core")
def core_distances(spark, sf):
    c = density.core_distances(team_units(spark, sf))
    return c.select("grp", F.col("pid").alias("number"), F.round("core", 9).alias("core"))


@query(f"""WITH {_HALF} SELECT d.grp, d.a, d.b, round(greatest(ca.core, cb.core, d.d), 9) AS w FROM (SELECT * FROM dist
    QUALIFY row_number() OVER (PARTITION BY grp, a ORDER BY d, b) <= 5) d
  JOIN core ca ON ca.grp = d.grp AND ca.number = d.a JOIN core cb ON cb.grp = d.grp AND cb.number = d.b""")
def mutual_reachability(spark, sf):
    """Between every vector and its five nearest neighbours of the team."""
    e = density.reachability_edges(team_units(spark, sf), 5)
    return e.select("grp", "a", "b", F.round("w", 9).alias("w"))


@query(f"""WITH RECURSIVE {_HALF}, mr AS (SELECT d.grp, a, b, greatest(ca.core, cb.core, d) AS w FROM dist d
    JOIN core ca ON ca.grp = d.grp AND ca.number = d.a JOIN core cb ON cb.grp = d.grp AND cb.number = d.b),
  prim AS (SELECT grp, [min(number)] AS seen, 0.0::DOUBLE AS total, count(*) AS n FROM h GROUP BY grp
    UNION ALL SELECT grp, list_append(seen, e.b), total + e.w, n FROM (SELECT p.grp, p.seen, p.total, p.n,
      arg_min({{'b': mr.b, 'w': mr.w}}, mr.w) AS e FROM prim p JOIN mr ON mr.grp = p.grp AND list_contains(p.seen, mr.a)
      AND NOT list_contains(p.seen, mr.b) GROUP BY ALL))
  SELECT grp, round(total, 6) AS weight, n - 1 AS edges FROM prim WHERE len(seen) = n""")
def mst_weight_per_team(spark, sf):
    t = density.spanning_tree(team_units(spark, sf))
    return t.groupBy("grp").agg(F.round(F.sum("w"), 6).alias("weight"), F.count("*").alias("edges"))


@query("""WITH e AS (SELECT 'team' || (label // 2) AS team, printf('N%06d', vec_id) AS number, label FROM embeddings)
  SELECT team, number, min(number) OVER (PARTITION BY label) AS first_member, count(*) OVER (PARTITION BY label) AS members FROM e""")
def cluster_per_team(spark, sf):
    """Two planted groups per team; the clustering must find exactly those."""
    v = D.team_vectors(spark, sf).withColumn("half", F.concat(F.lit("team"), F.floor(F.col("label") / 2)))
    c = density.cluster_per_team(v, "number", "vec", "half").select("team", "cluster", "number")
    first = c.groupBy("cluster").agg(F.min("number").alias("first_member"), F.count("*").alias("members"))
    return c.join(first, "cluster").drop("cluster")


@query(f"""WITH {S.VEC}, {S.ART} SELECT number, article_id, round(s, 6) AS similarity FROM vec LEFT JOIN (SELECT v.number, article_id,
    {S.cos('v.vec', 'a.vec')} AS s FROM vec v, art a WHERE is_active AND {S.cos('v.vec', 'a.vec')} >= 0.80
    QUALIFY row_number() OVER (PARTITION BY v.number ORDER BY s DESC, article_id) = 1) USING (number)""")
def nearest_article(spark, sf):
    v = D.team_vectors(spark, sf).select("number", "vec")
    n = search.nearest_article(v, D.existing_articles(spark, sf), "number")
    return n.select("number", "article_id", F.round("similarity", 6).alias("similarity"))


@query(f"""SELECT number, rank, neighbour FROM (SELECT number, CAST(rn AS INT) AS rank, b AS neighbour FROM (SELECT a.number, b.number AS b,
    row_number() OVER (PARTITION BY a.number ORDER BY {S.cos('a.vec', 'b.vec')} DESC, b.number) AS rn
  FROM vec a JOIN vec b ON a.team = b.team AND a.number <> b.number) WHERE rn <= 3)""".replace("SELECT number, rank", f"WITH {S.VEC} SELECT number, rank", 1))
def team_neighbours(spark, sf):
    """Three nearest incidents of the same team, by pruned cells (small parts, few pivots)."""
    v = blocks.prepare(D.team_vectors(spark, sf), "number", "vec", "cid", "team")
    k = blocks.knn(v, 3, block=128, pivots=16)
    return k.select(F.col("pid").alias("number"), "rank", F.col("cid").alias("neighbour"))


