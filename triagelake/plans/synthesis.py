"""The monthly knowledge synthesis as one Spark job over a window of closed incidents.

extract -> normalise -> scrub -> score -> floor -> embed -> cluster -> gate ->
representatives -> article -> validate -> dedup -> versioned upsert -> retire.
State lives in snapshot tables; every iterative step is cut by a checkpoint.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake import schemas
from triagelake.functions import scoring, text
from triagelake.functions.vectors import unit
from triagelake.operators import articles, blocks, cleaning, clusters, density, documents
from triagelake.operators.keyed import latest_per_key
from triagelake.session import cut_counted, cut_lineage
from triagelake.sources.readers import CLOSED_STATE, closed_incident_scan
from triagelake.sources.sinks import SnapshotTable

COUNTERS = ["extracted", "filtered", "clustered", "created", "updated", "flagged_for_review", "retired",
            "skipped"]
OUTCOMES = {"created": "create", "updated": "update", "flagged_for_review": "review"}


@dataclass
class Settings:
    # The thresholds of the monthly run.
    quality_floor: float = 0.40
    min_cluster_size: int = 5
    min_samples: int = 3
    min_cohesion: float = scoring.MIN_COHESION
    allow_single_cluster: bool = False
    representatives: int = 4
    parallel_calls: int | None = None
    model_version: str = "hashed-64"
    dim: int = 64
    retire_months: int = 6
    retire_count: int = 10
    retire_below: float = 0.30
    embed: Callable[[DataFrame, str, str], DataFrame] | None = None
    generator: articles.Generator | None = None
    as_of: str | None = None
    required: list[str] = field(default_factory=lambda: [
        "number", "short_description", "description", "close_notes", "close_code", "assignment_group",
        "category", "subcategory", "closed_at"])


class KnowledgeBase:
    """Snapshot tables of the synthesis: articles, their source incidents, run log, decisions.

    Source incidents are rows of a child table, so an article of a very large
    cluster stays one small row; `with_sources` builds the lists where they are wanted.
    """

    def __init__(self, spark: SparkSession, root: str):
        t = schemas.TABLES
        self.articles = SnapshotTable(spark, f"{root}/synthesized_kb", t["synthesized_kb"])
        self.sources = SnapshotTable(spark, f"{root}/synthesized_kb_sources", t["synthesized_kb_sources"])
        self.runs = SnapshotTable(spark, f"{root}/kb_synthesis_runs", t["kb_synthesis_runs"])
        self.decisions = SnapshotTable(spark, f"{root}/kb_synthesis_decisions", t["kb_synthesis_decisions"])


def _rows():
    return F.count(F.lit(1))


def with_sources(kb: KnowledgeBase, rows: DataFrame) -> DataFrame:
    """Article rows with their sorted list of source incidents, as an export needs it."""
    ids = kb.sources.read().join(rows.select(F.col("id").alias("article_id")), "article_id", "left_semi")
    lists = ids.groupBy("article_id").agg(F.array_sort(F.collect_list("incident_id")).alias("source_incident_ids"))
    return rows.join(lists.withColumnRenamed("article_id", "id"), "id", "left")


def latest_runs(kb: KnowledgeBase) -> DataFrame:
    """One row per run: the last state logged."""
    return latest_per_key(kb.runs.read(), ["run_id"], ["seq"])


def _log_run(spark, kb, run_id, seq, status, start, end, counts, durations, error, as_of) -> None:
    now = datetime.strptime(as_of, "%Y-%m-%d %H:%M:%S") if as_of else datetime.now(timezone.utc)
    row = (run_id, seq, now, None if status == "running" else now, status, start, end, counts, durations, error)
    new = spark.createDataFrame([row], schemas.TABLES["kb_synthesis_runs"])
    kb.runs.append(new)


def embed_default(df: DataFrame, text_col: str, out: str, dim: int) -> DataFrame:
    return documents.hash_embedding(df, text_col, dim, out)


def run_synthesis(spark: SparkSession, closed: DataFrame, kb: KnowledgeBase, start: str, end: str,
                  settings: Settings | None = None, recommendations: DataFrame | None = None,
                  run_id: str | None = None) -> dict[str, int]:
    """Run one window and return its counters. A failure is logged and raised."""
    s = settings or Settings()
    run_id = run_id or f"run-{start}-{end}-{kb.runs.current_version():06d}"
    days = date.fromisoformat(start), date.fromisoformat(end)
    counts = dict.fromkeys(COUNTERS, 0)
    durations: dict[str, float] = {}
    _log_run(spark, kb, run_id, 0, "running", *days, {}, {}, None, s.as_of)
    try:
        lost = cleaning.missing_fields(closed, s.required)
        if lost:
            _log_run(spark, kb, run_id, 1, "partial", *days, counts, durations,
                     "missing fields: " + ", ".join(lost), s.as_of)
            return counts
        _run(spark, closed, kb, start, end, s, recommendations, run_id, counts, durations)
        _log_run(spark, kb, run_id, 1, "succeeded", *days, counts, durations, None, s.as_of)
        return counts
    except Exception as e:
        _log_run(spark, kb, run_id, 1, "failed", *days, counts, durations, str(e), s.as_of)
        raise


def _run(spark, closed, kb, start, end, s, recommendations, run_id, counts, durations) -> None:
    clock = time.perf_counter()

    def lap(name: str) -> None:
        nonlocal clock
        durations[name] = time.perf_counter() - clock
        clock = time.perf_counter()

    def embed(df, text_col, out):
        return s.embed(df, text_col, out) if s.embed else embed_default(df, text_col, out, s.dim)

    as_of = F.lit(s.as_of).cast("timestamp") if s.as_of else F.current_timestamp()

    # 1-4: one pass from the extract to clean, scored rows.
    # An extract without a state column holds closed rows only.
    typed = closed.withColumn("_closed", F.try_to_timestamp("closed_at", F.lit("yyyy-M-d H:m:s")))
    typed = typed if "state" in closed.columns else typed.withColumn("state", F.lit(CLOSED_STATE))
    raw, seen = cut_counted(closed_incident_scan(typed, start, end, closed_at="_closed").drop("_closed"), extracted=_rows())
    counts.update(seen)
    clean, seen = cut_counted(cleaning.quality_gate(cleaning.prepare_incidents(raw), s.quality_floor), kept=_rows())
    counts["filtered"] = counts["extracted"] - seen["kept"]
    lap("filter")
    if seen["kept"] == 0:
        return

    # 5: vectors
    texts = clean.withColumn("_text", text.embedding_text(
        F.col("short_description"), F.col("description"), F.col("close_notes")))
    vectors = cut_lineage(embed(texts, "_text", "vec").drop("_text"))
    lap("embed")

    # 6-7: clusters and gate
    team = F.when(F.length("assignment_group") > 0, F.col("assignment_group")).otherwise("_unknown")
    named = vectors.withColumn("team", team)
    members = cut_lineage(density.cluster_per_team(
        named, "number", "vec", "team", s.min_cluster_size, s.min_samples, s.allow_single_cluster))
    measured = clusters.cohesion(members)
    good, seen = cut_counted(clusters.quality_gate(measured, s.min_cohesion)
                             .join(clusters.signatures(members), "cluster"), clustered=_rows())
    counts.update(seen)
    members = cut_lineage(members.join(good.select("cluster"), "cluster", "left_semi"))
    lap("cluster")
    if counts["clustered"] == 0:
        _retire(kb, recommendations, as_of, s, counts, kb.articles.read())
        lap("retire")
        return

    # 8-9: representatives and articles
    reps = clusters.representatives(members, clusters.medoids(members), s.representatives)
    reps = cut_lineage(reps.select("cluster", "rank", "number", "team").join(
        clean.select("number", "short_description", "description", "close_notes", "close_code"), "number"))
    made = (articles.generate(articles.synthesis_prompts(reps), s.generator, parallel=s.parallel_calls)
            if s.generator else articles.extractive_articles(reps))
    made, seen = cut_counted(articles.validate_articles(made).join(good, "cluster"), skipped=F.count_if(~F.col("valid")))
    counts.update(seen)
    skipped = made.where(~F.col("valid"))
    lap("synthesize")

    # 10-12: dedup against the stored articles and the ones created earlier in this run
    arts = articles.article_texts(made.where("valid"))
    arts = embed(embed(arts, "title_text", "embedding_title"), "full_text", "embedding_full")
    arts = cut_lineage(arts.withColumn("u", unit(F.col("embedding_title"))))
    stored = kb.articles.read()
    decided, seen = cut_counted(_decide(arts, stored), **{
        counter: F.count_if(F.col("decision") == decision) for counter, decision in OUTCOMES.items()})
    counts.update(seen)
    fresh = decided.join(arts, "signature")

    stored_now = fresh.where(F.col("decision") != "review")
    incoming = _article_rows(stored_now, s, run_id, as_of)
    links = members.select("cluster", F.col("number").alias("incident_id")).join(
        stored_now.select("cluster", _article_id(run_id).alias("article_id")), "cluster")
    merged = cut_lineage(articles.versioned_upsert(stored, incoming))
    lap("upsert_publish")

    # 13: retire; commits the articles before anything that names them
    _retire(kb, recommendations, as_of, s, counts, merged)
    kb.sources.append(links.select("article_id", "incident_id"))
    _log_decisions(kb, decided, skipped, merged, run_id, as_of)
    lap("retire")


def _decide(arts: DataFrame, stored: DataFrame) -> DataFrame:
    """(signature, target_signature, article_id, similarity, decision)."""
    probes = arts.select(F.lit("all").alias("grp"), F.col("signature").alias("pid"), "u").where(
        F.col("u").isNotNull())
    active = blocks.prepare(stored.where("is_active"), "id", "embedding_title", "cid")
    near = blocks.topk(probes, active, 1, scoring.REVIEW_AT).select(
        F.col("pid").alias("signature"), F.col("cid").alias("article_id"), F.col("score").alias("similarity"))
    sig = stored.select(F.col("id").alias("article_id"), F.col("cluster_signature").alias("target_signature"))
    cand = (arts.select("signature", "u").join(near, "signature", "left").join(sig, "article_id", "left")
                .select("signature", "u", "target_signature", "article_id", "similarity"))
    return articles.resolve_new_articles(cand)


def _article_id(run_id: str):
    return F.sha1(F.concat_ws("|", F.lit(run_id), "signature"))


def _article_rows(rows: DataFrame, s: Settings, run_id: str, as_of) -> DataFrame:
    """Rows of the article table without version and is_active; `seq` orders them in the run."""
    a = F.col("article")
    target = F.when(F.col("decision") == "update", F.col("target_signature")).otherwise(F.col("signature"))
    score = scoring.confidence(F.col("cohesion"), F.col("n"), a["confidence_self_rating"],
                               F.lit(None).cast("double"))
    dec = lambda c: c.cast("decimal(4,3)")                                          # noqa: E731
    return rows.select(
        _article_id(run_id).alias("id"), target.alias("cluster_signature"),
        a["title"].alias("title"), a["problem_summary"].alias("problem_summary"), a["root_cause"].alias("root_cause"),
        a["resolution_steps"].alias("resolution_steps"), a["keywords"].alias("keywords"),
        a["assignment_group"].alias("assignment_group"), a["category"].alias("category"),
        a["subcategory"].alias("subcategory"), F.col("n").cast("int").alias("source_incident_count"), dec(score).alias("confidence_score"),
        dec(a["confidence_self_rating"]).alias("llm_self_rating"), dec(F.col("cohesion")).alias("cluster_cohesion"),
        F.col("embedding_title").cast("array<double>").alias("embedding_title"),
        F.col("embedding_full").cast("array<double>").alias("embedding_full"),
        F.lit(None).cast("string").alias("page_id"), F.lit(s.model_version).alias("embedding_model_version"),
        as_of.alias("created_at"), F.lit(None).cast("timestamp").alias("retired_at"),
        F.col("signature").alias("seq"))


def _log_decisions(kb, decided, skipped, merged, run_id, as_of) -> None:
    new_id = _article_id(run_id)
    rows = decided.select(
        F.sha1(F.concat_ws("|", F.lit(run_id), F.lit("decision"), "signature")).alias("decision_id"),
        F.lit(run_id).alias("run_id"),
        F.when(F.col("decision") == "update", F.col("target_signature")).otherwise(F.col("signature"))
         .alias("cluster_signature"), "decision",
        F.when(F.col("decision") == "review", F.col("article_id")).otherwise(new_id).alias("article_id"),
        F.col("similarity").cast("decimal(4,3)").alias("similarity_score"),
        F.when(F.col("decision") == "review", "gray-zone similarity; human review required").alias("notes"),
        as_of.alias("created_at"))
    none = F.lit(None).cast("string")
    lost = skipped.select(
        F.sha1(F.concat_ws("|", F.lit(run_id), F.lit("decision"), "signature")).alias("decision_id"),
        F.lit(run_id).alias("run_id"), F.col("signature").alias("cluster_signature"), F.lit("skip").alias("decision"),
        none.alias("article_id"), F.lit(None).cast("decimal(4,3)").alias("similarity_score"),
        F.coalesce("error", F.concat(F.lit("invalid: "), F.array_join("problems", ","))).alias("notes"),
        as_of.alias("created_at"))
    kb.decisions.append(rows.unionByName(lost))


def _retire(kb, recommendations, as_of, s, counts, current) -> None:
    view = current.withColumnRenamed("id", "article_id")
    gone, seen = cut_counted(articles.retired_articles(view, recommendations, as_of, s.retire_months, s.retire_count,
                                                       s.retire_below).select("article_id"), retired=_rows())
    counts.update(seen)
    out = articles.retire(view, gone, as_of).withColumnRenamed("article_id", "id")
    kb.articles.commit(out.select(*current.columns))


def backfill(spark: SparkSession, closed: DataFrame, kb: KnowledgeBase, as_of: str, months: int,
             settings: Settings | None = None, recommendations: DataFrame | None = None) -> list[dict]:
    """Month windows oldest first; a failed window is recorded and the next ones still run."""
    done = []
    for w in articles.month_windows(spark, as_of, months).orderBy("window_start").collect():
        start, end = w["window_start"].isoformat(), w["window_end"].isoformat()
        try:
            done.append({"window": start, "status": "succeeded",
                         **run_synthesis(spark, closed, kb, start, end, settings, recommendations)})
        except Exception as e:
            done.append({"window": start, "status": "failed", "error": str(e)})
    return done
