"""The monthly job end to end on planted incidents."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagelake.operators import articles
from triagelake.plans import synthesis
from triagelake.sources.sinks import SnapshotTable, export_articles

TOPICS = {"disk": "disk volume full cleanup partition storage quota", "login": "login password session token expired account",
          "queue": "queue message backlog consumer broker stalled"}


def incidents(spark, month, per_topic=8, extra=()):
    rng = np.random.default_rng(month)
    rows = []
    for team in ("ops", ""):
        for t, words in TOPICS.items():
            for i in range(per_topic):
                pick = " ".join(rng.permutation(words.split()))
                rows.append((f"INC{month}{team or 'x'}{t}{i:02d}", f"{t} problem {pick}", f"report of {pick}",
                             f"step 1: handle {pick}. " + (pick + " ") * 12, "Solved (Permanently)", team, None, None,
                             f"2026-{month:02d}-10 08:{i:02d}:00", "7"))
    rows.append((f"INC{month}dup", "x", "y", "dup of other", "Duplicate", "ops", None, None, f"2026-{month:02d}-11 08:00:00", "7"))
    rows.append((f"INC{month}open", "x", "y", "step 1: z", "Solved (Permanently)", "ops", None, None, f"2026-{month:02d}-11 08:00:00", "2"))
    rows += list(extra)
    return spark.createDataFrame(rows, "number string, short_description string, description string, close_notes string, "
                                 "close_code string, assignment_group string, category string, subcategory string, "
                                 "closed_at string, state string")


@pytest.fixture
def kb(spark, tmp_path):
    return synthesis.KnowledgeBase(spark, str(tmp_path / "kb"))


def test_two_months(spark, kb, tmp_path):
    s = synthesis.Settings(as_of="2026-06-01 00:00:00")
    may = incidents(spark, 5)
    c = synthesis.run_synthesis(spark, may, kb, "2026-05-01", "2026-05-31", s)
    assert c["extracted"] == 49 and c["filtered"] == 1
    # HDBSCAN may split a topic further; every cluster gets a decision.
    assert c["clustered"] == c["created"] + c["updated"] + c["flagged_for_review"] + c["skipped"] >= 2
    assert c["created"] >= 1
    rows = kb.articles.read().collect()
    assert len(rows) == c["created"] + c["updated"]
    for sig in {r.cluster_signature for r in rows}:
        assert sum(r.is_active for r in rows if r.cluster_signature == sig) == 1
    assert kb.sources.read().select("article_id").distinct().count() == len(rows)
    log = synthesis.latest_runs(kb).collect()
    assert [(r.status, r.counts["extracted"]) for r in log] == [("succeeded", 49)]

    # The same texts next month: the titles match what is stored, so nothing new is created.
    june = synthesis.run_synthesis(spark, incidents(spark, 5).withColumn(
        "closed_at", F.regexp_replace("closed_at", "2026-05", "2026-06")), kb, "2026-06-01", "2026-06-30", s)
    assert june["created"] == 0 and june["updated"] == june["clustered"]
    d = kb.decisions.read()
    assert d.where("decision = 'update'").count() >= june["updated"]
    active = kb.articles.read().where("is_active")
    assert active.groupBy("cluster_signature").count().where("count > 1").count() == 0

    out = synthesis.with_sources(kb, active).select("id", F.struct(
        "title", "problem_summary", "root_cause", "resolution_steps", "keywords").alias("article"), "source_incident_ids")
    m = articles.article_markup(out, key="id")
    export_articles(m, str(tmp_path / "pages"))
    assert spark.read.text(str(tmp_path / "pages"), wholetext=False).count() >= 1
    assert all(r.body.startswith("<h1>") and "incidents: INC" in r.body for r in m.collect())


def test_generator_failure_and_empty_window(spark, kb):
    def broken(prompt):
        raise RuntimeError("no model")
    s = synthesis.Settings(as_of="2026-06-01 00:00:00", generator=broken)
    c = synthesis.run_synthesis(spark, incidents(spark, 5), kb, "2026-05-01", "2026-05-31", s)
    assert c["created"] == 0 and c["skipped"] == c["clustered"] > 0
    skips = kb.decisions.read().where("decision = 'skip'")
    assert skips.count() == c["skipped"] and "no model" in skips.first().notes
    empty = synthesis.run_synthesis(spark, incidents(spark, 5), kb, "2026-01-01", "2026-01-31", s)
    assert set(empty.values()) == {0}


def test_missing_field_is_partial_and_backfill_goes_on(spark, kb):
    s = synthesis.Settings(as_of="2026-06-01 00:00:00")
    synthesis.run_synthesis(spark, incidents(spark, 5).drop("close_code"), kb, "2026-05-01", "2026-05-31", s)
    assert [r.status for r in synthesis.latest_runs(kb).collect()] == ["partial"]

    def flaky(df, text_col, out):
        raise ValueError("embedder down")
    done = synthesis.backfill(spark, incidents(spark, 5), kb, "2026-07-03", 2,
                              synthesis.Settings(as_of="2026-06-01 00:00:00", embed=flaky))
    assert [(d["window"], d["status"]) for d in done] == [("2026-05-01", "failed"), ("2026-06-01", "succeeded")]
    assert {r.status for r in synthesis.latest_runs(kb).collect()} == {"partial", "failed", "succeeded"}


def test_retire_in_run(spark, kb):
    s = synthesis.Settings(as_of="2026-06-01 00:00:00")
    synthesis.run_synthesis(spark, incidents(spark, 5), kb, "2026-05-01", "2026-05-31", s)
    victim = kb.articles.read().where("is_active").first().id
    recs = spark.createDataFrame([(victim, 0.1, dt.datetime(2026, 5, 20))] * 10,
                                 "article_id string, feedback_score double, created_at timestamp")
    c = synthesis.run_synthesis(spark, incidents(spark, 1), kb, "2026-04-01", "2026-04-30", s, recs)
    assert c["extracted"] == 0
    c = synthesis.run_synthesis(spark, incidents(spark, 4, 3), kb, "2026-04-01", "2026-04-30", s, recs)
    assert c["retired"] == 1
    assert kb.articles.read().where(F.col("id") == victim).first().is_active is False


def test_snapshot_commit(spark, tmp_path):
    t = SnapshotTable(spark, str(tmp_path / "t"), "a int")
    assert t.read().count() == 0
    t.commit(spark.range(3).selectExpr("cast(id as int) a"))
    t.commit(t.read().where("a > 0"))
    assert t.current_version() == 2 and sorted(r.a for r in t.read().collect()) == [1, 2]
    t.append(spark.range(7, 8).selectExpr("cast(id as int) a"))
    t.append(spark.range(8, 9).selectExpr("cast(id as int) a"))
    assert t.current_version() == 4 and sorted(r.a for r in t.read().collect()) == [1, 2, 7, 8]
