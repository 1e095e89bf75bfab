"""Keyed state, windows and TTL dedup against brute force."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from triagelake.operators import articles, chat, intervals, keyed, loganalysis, routing, runstate

T0 = dt.datetime(2024, 1, 1)


def brute_ttl(rows, ttl):
    kept = []
    for k in sorted({r[1] for r in rows}):
        last = None
        for t, i in sorted((r[2], r[0]) for r in rows if r[1] == k):
            if last is None or (t - last).total_seconds() >= ttl:
                kept.append((k, i))
                last = t
    return sorted(kept)


def ttl_events(n=400, seed=5):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice("aab"), T0 + dt.timedelta(seconds=rnd.randint(0, 9000))) for i in range(n)]
    rows += [(1000, "gap", T0), (1001, "gap", T0 + dt.timedelta(seconds=200)), (1002, "gap", T0 + dt.timedelta(seconds=299)),
             (1003, "gap", T0 + dt.timedelta(seconds=301)), (1004, "far", T0), (1005, "far", T0 + dt.timedelta(days=2))]
    return rows


def dense_events(step, n=900, seed=8):
    """One key with nearly all rows in a single segment, and a few others."""
    rnd = random.Random(seed)
    rows = [(i, "hot", T0 + dt.timedelta(seconds=i * step + rnd.randint(0, step))) for i in range(n)]
    return rows + [(n + i, rnd.choice("ahiz"), T0 + dt.timedelta(seconds=rnd.randint(0, 3000))) for i in range(200)]


@pytest.mark.parametrize("partitions", [1, 5, 23])
@pytest.mark.parametrize("rows", [ttl_events(), dense_events(1), dense_events(40), dense_events(170), []],
                         ids=["mixed", "within", "dense", "sparse", "empty"])
def test_dedup_ttl(spark, rows, partitions):
    """Keys inside one partition, over some, and with many partitions inside one TTL."""
    df = spark.createDataFrame(rows, "id bigint, k string, ts timestamp")
    want = brute_ttl(rows, 300)
    if rows == ttl_events():
        assert ("gap", 1003) in want and ("gap", 1001) not in want
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        for c, v in zip(before, (str(partitions), "false"), strict=True):
            spark.conf.set(c, v)
        got = routing.dedup_ttl(df, "k", "ts", "id", 300).collect()
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert sorted((r.k, r.id) for r in got) == want


def test_dedup_ttl_nulls_and_ties(spark):
    rows = [(3, "k", T0), (2, "k", T0), (None, "k", T0), (4, None, T0), (5, "k", None), (6, "k", T0 + dt.timedelta(seconds=300))]
    df = spark.createDataFrame(rows, "id bigint, k string, ts timestamp")
    assert sorted((r.k, r.id) for r in routing.dedup_ttl(df, "k", "ts", "id", 300).collect()) == [("k", 2), ("k", 6)]


def test_running_sum_slices(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice("ab"), i, rnd.randint(0, 9)) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, i int, v int").withColumn("s", F.floor(F.col("i") / 7))
    for desc in (False, True):
        order = [F.col("i").desc() if desc else F.col("i")]
        got = {r.i: r.t for r in keyed.running_sum(df, ["k"], "s", order, "v", "t", desc).collect()}
        for k, i, _ in rows:
            assert got[i] == sum(v for kk, j, v in rows if kk == k and (j >= i if desc else j <= i))


def test_ordinal(spark):
    rows = [("h", i) for i in range(300)] + [("s", 5), ("s", 1)]
    random.Random(2).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, v int").repartition(7)
    got = {(r.k, r.v): r.n for r in keyed.ordinal(df, ["k"], ["v"], "n").collect()}
    assert all(got["h", i] == i + 1 for i in range(300)) and got["s", 1] == 1 and got["s", 5] == 2


def test_windows_against_pairs(spark):
    rnd = random.Random(3)
    logs = [(i, T0 + dt.timedelta(seconds=rnd.randint(0, 3000)), rnd.randint(0, 1), rnd.choice("xy")) for i in range(300)]
    inc = [(f"I{i}", rnd.randint(0, 2), T0 + dt.timedelta(seconds=rnd.randint(0, 3000))) for i in range(60)]
    logs += [(900, T0 + dt.timedelta(seconds=100), 0, "x"), (901, T0 + dt.timedelta(seconds=700), 0, "x")]
    inc.append(("EDGE", 0, T0 + dt.timedelta(seconds=400)))
    w = dt.timedelta(seconds=300)
    ldf = spark.createDataFrame(logs, "event_id int, ts timestamp, entity int, item string")
    wdf = spark.createDataFrame([(a, e, t - w, t + w) for a, e, t in inc], "id string, entity int, lo timestamp, hi timestamp")
    got = intervals.newest_in_window(ldf, wdf, "entity", "id", "event_id", 5).collect()
    cnt = intervals.counts_in_window(ldf, wdf, "entity", ["item"], "id", 600).collect()
    want, wcnt = set(), {}
    for a, e, t in inc:
        hits = sorted(((lt, i, it) for i, lt, le, it in logs if le == e and t - w <= lt <= t + w), reverse=True)
        want |= {(a, i, r + 1) for r, (_, i, _) in enumerate(hits[:5])}
        for _, _, it in hits:
            wcnt[a, it] = wcnt.get((a, it), 0) + 1
    assert {(r.id, r.event_id, r["rank"]) for r in got} == want
    assert {(r.id, r["item"]): r.n for r in cnt} == wcnt


def test_log_entities_and_empty_window(spark):
    logs = spark.createDataFrame([(1, T0, "ERROR", "a", "h", "s", "h")],
                                 "event_id int, ts timestamp, level string, content string, host string, service string, pg string")
    e = loganalysis.by_entity(logs, ["host", "service", "pg"])
    assert sorted(r.entity for r in e.collect()) == ["h", "s"]
    inc = spark.createDataFrame([("I1", "h", "P1", T0), ("I2", "zzz", "P1", T0)],
                                "external_id string, entity string, severity string, opened_at timestamp")
    got = {r.external_id: (r.scanned, r.errors, r.classification) for r in loganalysis.analyse_logs(inc, e).collect()}
    assert got == {"I1": (1, 1, "unknown"), "I2": (0, 0, "unknown")}


def test_patch_keeps_status(spark):
    log = spark.createDataFrame([(1, 1, "completed", None), (1, 2, None, 500)], "run_id int, seq int, status string, ms int")
    r = runstate.apply_run_patches(log, ["status", "ms"], ["seq"]).first()
    assert (r.status, r.ms) == ("completed", 500)


def test_trim_stops_at_first_overflow(spark):
    rows = [(1, 0, "user", "a" * 4), (1, 1, "user", "b" * 400), (1, 2, "user", "c" * 8), (1, 3, "user", "d" * 4)]
    df = spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")
    assert sorted(r.turn for r in chat.trim_history(df, 50, slice_turns=2).collect()) == [2, 3]


def test_versions(spark):
    stored = spark.createDataFrame([("s", 1, True, "one"), ("t", 1, True, "x")],
                                   "cluster_signature string, version int, is_active boolean, title string")
    new = spark.createDataFrame([("s", "two", "a"), ("s", "three", "b"), ("u", "new", "a")],
                                "cluster_signature string, title string, seq string")
    got = sorted((r.cluster_signature, r.version, r.is_active, r.title)
                 for r in articles.versioned_upsert(stored, new).collect())
    assert got == [("s", 1, False, "one"), ("s", 2, False, "two"), ("s", 3, True, "three"),
                   ("t", 1, True, "x"), ("u", 1, True, "new")]


def test_retire_edges(spark):
    now = dt.datetime(2024, 7, 1)
    def recs(a, n, score, at=now):
        return [(a, score, at)] * n
    rows = (recs("nine", 9, .1) + recs("ten", 10, .29) + recs("edge", 10, .30) + recs("null", 12, None)
            + recs("old", 12, .1, dt.datetime(2023, 12, 1)) + recs("off", 12, .1))
    r = spark.createDataFrame(rows, "article_id string, feedback_score double, created_at timestamp")
    a = spark.createDataFrame([(x, x != "off") for x in ("nine", "ten", "edge", "null", "old", "off", "none")],
                              "article_id string, is_active boolean")
    as_of = F.lit("2024-07-01 00:00:00").cast("timestamp")
    assert [x.article_id for x in articles.retired_articles(a, r, as_of).collect()] == ["ten"]
    assert articles.retired_articles(a, None, as_of).count() == 0


def test_windows_of_months(spark):
    got = [(str(a), str(b)) for a, b in articles.month_windows(spark, "2026-03-15", 3).orderBy("window_start").collect()]
    assert got == [("2025-12-01", "2025-12-31"), ("2026-01-01", "2026-01-31"), ("2026-02-01", "2026-02-28")]


def test_parse_and_route(spark):
    raw = spark.createDataFrame([
        ('{"problemId":"P1","displayName":"t","severity":"availability","status":"OPEN","eventType":"x","tags":["a","app:ehr"],'
         '"impactedEntities":[{"name":"h1"}],"other":1}',),
        ('{"problemId":"P2","displayName":"t","severity":"weird","status":"resolved","eventType":"x"}',),
        ('{"problemId":"P3"}',), ("not json",)], "value string")
    good, bad = routing.parse_problem_events(raw)
    assert (good.count(), bad.count()) == (2, 2)
    r = routing.route_problem_events(good).collect()
    assert len(r) == 1 and (r[0].severity, r[0].flow, r[0].host, r[0].service, r[0].dedup_key) == (
        "P1", "primary", "h1", "ehr", "dt:P1")
    assert "other" in r[0].raw_payload
