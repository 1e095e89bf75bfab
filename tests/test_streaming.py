"""Streaming jobs against their batch forms on the same rows."""

import datetime as dt
import json
import random

from pyspark.sql import functions as F

from triagelake.operators import routing, runstate
from triagelake.sources import sinks
from triagelake.sources.eventlog import EventLog
from triagelake.streaming import jobs

T0 = dt.datetime(2024, 1, 1)
EVENT = "event_id bigint, ts timestamp, run_id bigint, event string, agent_num int"


def drain(df, path, mode="append", name="out"):
    """Run a query to the end of its input and return its rows."""
    rows = []
    q = (df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/ckpt-{name}")
         .foreachBatch(lambda b, n: rows.extend(b.collect())).trigger(availableNow=True).start())
    q.awaitTermination(120)
    assert q.exception() is None
    return rows


def files(path, groups):
    """One JSON file per group, with rising modification times."""
    import os
    path.mkdir()
    for i, g in enumerate(groups):
        f = path / f"{i}.json"
        f.write_text("\n".join(json.dumps(r) for r in g))
        os.utime(f, (1_700_000_000 + i, 1_700_000_000 + i))
    return str(path)


def at(s):
    return (T0 + dt.timedelta(seconds=s)).strftime("%Y-%m-%dT%H:%M:%S")


def exact_dedup(spark, src, tmp_path, schema, **how):
    e = jobs.read_events(spark, src, schema, files_per_trigger=1)
    q = jobs.dedup_exact(e, str(tmp_path / "out"), str(tmp_path / "ckpt"), availableNow=True, **how)
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.read.schema(schema).parquet(str(tmp_path / "out/accepted"))


def test_exact_dedup(spark, tmp_path):
    schema = "dedup_key string, ts timestamp, n int"
    seconds = [[0, 200], [299, 301], [650, 900]]
    src = files(tmp_path / "in", [[{"dedup_key": "k", "ts": at(s), "n": s} for s in g] for g in seconds])
    got = exact_dedup(spark, src, tmp_path, schema, id_col="n")
    assert sorted(r.n for r in got.collect()) == [0, 301, 650]
    batch = spark.read.schema(schema).json(src)
    assert sorted(r.n for r in routing.dedup_ttl(batch, "dedup_key", "ts", "n").collect()) == [0, 301, 650]


def test_exact_dedup_equals_batch(spark, tmp_path):
    """A key with most rows, gaps in which the state goes, equal instants, rows without a key or an instant."""
    rnd = random.Random(4)
    rows = [{"dedup_key": rnd.choice("hhhhab"), "ts": at(s // 2), "event_id": s, "other": "x"} for s in range(0, 4000, 7)]
    rows += [{"dedup_key": "gone", "ts": at(0), "event_id": 9001}, {"dedup_key": None, "ts": at(0), "event_id": 9002},
             {"dedup_key": "h", "ts": None, "event_id": 9003}]
    rows.sort(key=lambda r: (r["ts"] or "", r["event_id"]))
    tail = [{"dedup_key": "gone", "ts": at(9000), "event_id": 9004}]
    schema = "dedup_key string, ts timestamp, event_id bigint, other string"
    src = files(tmp_path / "in", [rows[:200], rows[200:230], rows[230:], tail])
    got = exact_dedup(spark, src, tmp_path, schema)
    batch = routing.dedup_ttl(spark.read.schema(schema).json(src), "dedup_key", "ts", "event_id")
    want = sorted((r.dedup_key, r.event_id) for r in batch.collect())
    assert sorted((r.dedup_key, r.event_id) for r in got.collect()) == want and len(want) > 10
    assert {r.other for r in got.where("event_id < 9000").collect()} == {"x"}
    state = spark.read.parquet(str(tmp_path / "out/state/batch=3"))
    assert [r.key for r in state.collect()] == ["gone"]


def test_exact_dedup_late_rows(spark, tmp_path):
    """Late, but within the time allowed: judged against what was accepted. Later than that: left out."""
    schema = "dedup_key string, ts timestamp, event_id bigint"
    src = files(tmp_path / "in", [[{"dedup_key": k, "ts": at(s), "event_id": i} for i, (k, s) in enumerate(g, 10 * n)]
                                  for n, g in enumerate([[("a", 0), ("b", 1000)], [("a", 800), ("c", 600)], [("a", 1050), ("c", 900)]])])
    assert sorted(r.event_id for r in exact_dedup(spark, src, tmp_path, schema).collect()) == [0, 1, 10, 21]


def test_loose_dedup(spark, tmp_path):
    src = files(tmp_path / "in", [[{"number": "A", "ts": at(s)} for s in (0, 100)], [{"number": "B", "ts": at(120)}]])
    e = jobs.read_events(spark, src, "number string, ts timestamp", files_per_trigger=1)
    assert sorted(r.number for r in drain(jobs.dedup_loose(e, "number"), tmp_path)) == ["A", "B"]


def test_route(spark, tmp_path):
    a = {"problemId": "P1", "displayName": "t", "severity": "ERROR", "status": "OPEN", "eventType": "x"}
    src = files(tmp_path / "in", [[{"kind": "problem", "value": json.dumps(a)},
                                   {"kind": "ticket", "value": json.dumps({"number": "INC1", "priority": "5", "short_description": "s"})},
                                   {"kind": "ticket", "value": "broken"}]])
    e = jobs.read_events(spark, src, "kind string, value string")
    got = {(r.external_id, r.severity, r.flow) for r in drain(jobs.route(e), tmp_path)}
    assert got == {("P1", "P3", "primary"), ("INC1", "P5", "secondary")}


def run_rows():
    rows, i = [], 0
    for run in (1, 2):
        for s, ev, agent in [(0, "pipeline_started", 0), (5, "agent_start", 1), (9, "agent_done", 1), (12, "agent_start", 2),
                             (20 + run, "agent_error" if run == 1 else "agent_done", 2), (30, "pipeline_complete", 0)]:
            rows.append({"event_id": i, "ts": at(s), "run_id": run, "event": ev, "agent_num": agent})
            i += 1
    return rows


def test_run_state_equals_batch(spark, tmp_path):
    rows = run_rows()
    late = {"event_id": 99, "ts": at(1), "run_id": 1, "event": "agent_start", "agent_num": 2}     # older: no effect
    src = files(tmp_path / "in", [rows[:4], rows[4:9], rows[9:] + [late]])
    got = drain(jobs.run_state(jobs.read_events(spark, src, EVENT, files_per_trigger=1)), tmp_path, "update")
    last = {}
    for r in got:
        if not r.closed:
            last[r.run_id] = (r.status, {(a.agent_num, a.status, a.started_us, a.completed_us, a.errors) for a in r.agents})
    batch = spark.read.schema(EVENT).json(src)
    steps = {}
    us = [F.unix_micros(c).alias(c) for c in ("started_at", "completed_at")]
    for r in runstate.fold_steps(batch).select("run_id", "agent_num", "status", "errors", *us).collect():
        steps.setdefault(r.run_id, set()).add((r.agent_num, r.status, r.started_at, r.completed_at, r.errors))
    status = {r.run_id: r.status for r in runstate.fold_runs(batch).collect()}
    assert last == {k: (status[k], steps[k]) for k in status}
    assert {a[:2] for a in last[1][1]} == {(1, "completed"), (2, "failed")}


def test_run_state_ties(spark, tmp_path):
    """Equal instants: the larger event id wins, whatever the order of arrival."""
    rows = [{"event_id": i, "ts": at(0), "run_id": 1, "event": e, "agent_num": 0}
            for i, e in ((5, "pipeline_error"), (4, "pipeline_complete"))]
    src = files(tmp_path / "in", [rows[:1], rows[1:]])
    got = drain(jobs.run_state(jobs.read_events(spark, src, EVENT, files_per_trigger=1)), tmp_path, "update")
    assert [r.status for r in got if not r.closed][-1] == "failed"


def test_volume_and_sink(spark, tmp_path):
    rows = [{"event_id": i, "ts": at(600 * i), "run_id": i, "event": "pipeline_complete", "agent_num": 0} for i in range(12)]
    src = files(tmp_path / "in", [rows[:6], rows[6:]])
    e = jobs.read_events(spark, src, EVENT, files_per_trigger=1)
    got = {r.bucket: r.completed for r in drain(jobs.volume(e), tmp_path, "update")}
    assert sum(got.values()) == 12 and len(got) == 2
    out = str(tmp_path / "out")
    for _ in range(2):                               # the second start finds nothing new
        q = jobs.sink(e, out, str(tmp_path / "ckpt-sink"), availableNow=True)
        q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 12


def test_field_decoding(spark):
    df = spark.createDataFrame([("1", '{"a":1}'), ("2", "plain"), ("3", '"quoted"')], "id string, data string")
    got = {r.id: r.data for r in jobs.decode_fields(df, ["data"]).collect()}
    assert got == {"1": '{"a":1}', "2": "plain", "3": "quoted"}


def test_sources_are_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert jobs.read_events(spark, str(tmp_path / "in"), EVENT).isStreaming


def test_forward_once(spark, tmp_path):
    """A number is forwarded once over many batches, also long after the watermark passed its first row."""
    polls = [[("A", 0), ("A", 20), ("B", 100)], [("B", 100), ("C", 900)], [("A", 2000), ("D", 2000)], [("A", 4000), ("D", 4100), ("C", 4200)],
             [("E", 200_000)], [("F", 200_100)], [("A", 200_200)]]
    src = files(tmp_path / "in", [[{"number": n, "created_at": at(s), "s": s} for n, s in g] for g in polls])
    e = jobs.read_events(spark, src, "number string, created_at timestamp, s int", files_per_trigger=1)
    got = drain(jobs.forward_once(e), tmp_path)
    # A comes back after more than a day and is new again.
    assert sorted((r.number, r.s) for r in got) == [("A", 0), ("A", 200_200), ("B", 100), ("C", 900), ("D", 2000), ("E", 200_000), ("F", 200_100)]


def test_live_counters_equal_batch(spark, tmp_path):
    import random
    rnd = random.Random(4)
    kinds = ["pipeline_complete", "pipeline_error", "pipeline_started", "agent_done"]
    rows = [{"event_id": i, "ts": at(rnd.randint(0, 3600 * (5 + i // 40))), "run_id": i % 50, "event": rnd.choice(kinds), "agent_num": 1}
            for i in range(600)]
    src = files(tmp_path / "in", [rows[i:i + 60] for i in range(0, 600, 60)])
    e = jobs.read_events(spark, src, EVENT, files_per_trigger=1)
    want = {r.bucket: (r.completed_total, r.active)
            for r in runstate.live_counters(spark.read.schema(EVENT).json(src), 200).collect()}
    last = {r.bucket: (r.completed_total, r.active) for r in drain(jobs.live_counters(e, 200), tmp_path, "update")}
    assert last == want and min(a for _, a in want.values()) == 0
    few = drain(jobs.live_counters(e, 200, open_buckets=3), tmp_path, "update", "few")
    assert max((r.bucket, r.completed_total, r.active) for r in few)[1:] == max((b, *v) for b, v in want.items())[1:]


def test_retention_equals_batch(spark, tmp_path):
    """The changes of the stream sum to the rows of the batch form; a hot run, ties, repeated and late rows."""
    import random
    from collections import Counter
    rnd = random.Random(8)
    rows = [{"event_id": i % 380, "ts": at(rnd.randint(0, 60) + i), "run_id": 1 if i % 3 == 0 else i % 7} for i in range(400)]
    src = files(tmp_path / "in", [rows[i:i + 80] for i in range(0, 400, 80)])
    e = jobs.read_events(spark, src, EVENT, files_per_trigger=1)
    net: Counter = Counter()
    for r in drain(jobs.retain_per_run(e, 10), tmp_path):
        net[r.run_id, r.event_id, r.ts] += r.change
    batch = sinks.retain_per_run(spark.read.schema(EVENT).json(src).select("run_id", "event_id", "ts").distinct(), 10).collect()
    assert set(net.values()) <= {0, 1}
    assert {k for k, n in net.items() if n} == {(r.run_id, r.event_id, r.ts) for r in batch}


def test_retention_drops_idle_runs(spark, tmp_path):
    groups = [[{"event_id": 1, "ts": at(0), "run_id": 1}], [{"event_id": 2, "ts": at(9000), "run_id": 2}],
              [{"event_id": 3, "ts": at(9100), "run_id": 2}]]
    e = jobs.read_events(spark, files(tmp_path / "in", groups), EVENT, files_per_trigger=1)
    got = sorted((r.run_id, r.event_id, r.change) for r in drain(jobs.retain_per_run(e), tmp_path))
    assert got == [(1, 1, -1), (1, 1, 1), (2, 2, 1), (2, 3, 1)]


def log_part(path, name, ids, rows=10):
    import pyarrow as pa
    import pyarrow.parquet as pq
    path.mkdir(exist_ok=True)
    pq.write_table(pa.table({"event_id": pa.array(ids, pa.int64()), "event": [f"e{i}" for i in ids]}), path / name, row_group_size=rows)


def test_event_log_from_an_id_and_after_a_restart(spark, tmp_path):
    spark.dataSource.register(EventLog)
    log_part(tmp_path / "log", "a.parquet", range(100))
    log_part(tmp_path / "log", "b.parquet", range(100, 130))

    def run(**options):
        # A new reader each time; the checkpoint has the last id.
        return sorted((r.event_id, r.event) for r in drain(
            spark.readStream.format("event_log").options(path=str(tmp_path / "log"), **options).load(), tmp_path,
            name="log" + str(options.get("after", ""))))

    entry = lambda i: (i, f"e{i}")                                                  # noqa: E731
    assert run(after=41) == [entry(i) for i in range(42, 130)]
    assert run(after=41) == []
    log_part(tmp_path / "log", "c.parquet", range(125, 150))
    assert run(after=41) == [entry(i) for i in range(130, 150)]
    assert run() == sorted([*map(entry, range(130)), *map(entry, range(125, 150))])
    assert run(after=500) == []


def test_event_log_opens_the_wanted_row_groups_only(tmp_path):
    from triagelake.sources.eventlog import EventLogReader
    log_part(tmp_path / "log", "a.parquet", range(100))
    log_part(tmp_path / "log", "empty.parquet", [])
    r = EventLogReader({"path": str(tmp_path / "log"), "after": "41"}, ["event_id"])
    assert r.initialOffset() == {"id": 41} and r.latestOffset() == {"id": 99}
    parts = r.partitions({"id": 41}, {"id": 59})
    assert [p.group for p in parts] == [4, 5]
    assert [i for p in parts for b in r.read(p) for i in b.column(0).to_pylist()] == list(range(42, 60))
