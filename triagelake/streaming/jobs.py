"""Structured Streaming forms of routing, dedup, run state, volumes and the event sink."""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from triagelake import schemas
from triagelake.operators import routing
from triagelake.operators.runstate import RUN_OF_EVENT
from triagelake.sources.sinks import EXPIRE_SECONDS, KEEP_PER_RUN, append_batch

TTL_SECONDS, IDLE_SECONDS = 300, 3600       # fixed values: lock time, context expiry
SEEN_SECONDS = 24 * 3600                    # how long a polled number stays known


def read_events(spark: SparkSession, path: str, schema, fmt: str = "json",
                files_per_trigger: int = 100) -> DataFrame:
    """File source; the checkpoint of the query is the resume position."""
    return (spark.readStream.schema(schema).format(fmt)
            .option("maxFilesPerTrigger", files_per_trigger).load(path))


def decode_fields(entries: DataFrame, fields: list[str]) -> DataFrame:
    """Stream entry fields: JSON text is decoded, other text stays as it is."""
    def one(name):
        c = F.col(name)
        quoted = F.get_json_object(F.concat(F.lit('{"v":'), c, F.lit("}")), "$.v")
        return F.coalesce(quoted, c).alias(name)
    return entries.select(*[c for c in entries.columns if c not in fields], *[one(f) for f in fields])


def route(raw: DataFrame, value: str = "value") -> DataFrame:
    """Stateless: payloads of both sources to event rows. `kind` tells the source."""
    keep = [c for c in raw.columns if c not in (value, "kind")]
    a, _ = routing.parse_problem_events(raw.where(F.col("kind") == "problem"), value)
    b, _ = routing.parse_ticket_events(raw.where(F.col("kind") == "ticket"), value)
    return (routing.route_problem_events(a.select("p", value, *keep), value, keep)
            .unionByName(routing.route_ticket_events(b.select("p", value, *keep), value, keep)))


def dedup_exact(events: DataFrame, path: str, checkpoint: str, key: str = "dedup_key", ts: str = "ts", id_col: str = "event_id",
                ttl_seconds: int = TTL_SECONDS, late_seconds: int = 300, **trigger):
    """Start a query that stores the first event per key, then the first at least TTL after the last accepted one.

    Each micro-batch goes through the batch operator, so a key with a third of its rows is
    spread over many tasks. What is carried on is a table of the last accepted instant of
    each key, one folder per batch (`path/state`, the accepted rows in `path/accepted`); a
    replayed batch reads the state before it and replaces its own folders. An event later
    than `late_seconds` behind the newest one of the batches before is left out, and a key's
    instant goes when no event can fall within its TTL any more. Rows without a key or an
    instant are left out; of equal instants of a key the smallest id stays.
    """
    def state(spark: SparkSession, batch_id: int) -> DataFrame | None:
        return spark.read.parquet(f"{path}/state/batch={batch_id}") if batch_id >= 0 else None

    def one(batch: DataFrame, batch_id: int) -> None:
        spark, us = batch.sparkSession, F.unix_micros(F.col(ts).cast("timestamp"))
        ttl, late = ttl_seconds * 1_000_000, late_seconds * 1_000_000
        rows = batch.where(F.col(key).isNotNull() & F.col(ts).isNotNull())
        fresh, newest, before = rows, rows.agg(F.max(us)).first()[0], state(spark, batch_id - 1)
        if before is not None:
            earlier = before.agg(F.max("newest")).first()[0]
            newest = max((n for n in (newest, earlier) if n is not None), default=None)
            last = before.select(F.col("key").alias("_key"), "last")
            fresh = (rows.where(us >= (earlier - late if earlier is not None else -2**62)).join(last, F.col(key) == F.col("_key"), "left")
                     .where(F.col("last").isNull() | (us >= F.col("last") + ttl)).drop("_key", "last"))
        kept = routing.dedup_ttl(fresh, key, ts, id_col, ttl_seconds)
        named = kept.select(F.col(key).alias("_key"), F.col(ts).alias("_ts"), F.col(id_col).alias("_id"))
        same = (F.col(key) == F.col("_key")) & (F.col(ts).cast("timestamp") == F.col("_ts")) & F.col(id_col).eqNullSafe(F.col("_id"))
        append_batch(rows.join(named, same, "left_semi").dropDuplicates([key, ts, id_col]), batch_id, f"{path}/accepted")

        seen = spark.read.schema(rows.schema).parquet(f"{path}/accepted/batch={batch_id}").select(F.col(key).alias("key"), us.alias("last"))
        seen = seen if before is None else seen.unionByName(before.select("key", "last"))
        after = seen.groupBy("key").agg(F.max("last").alias("last")).withColumn("newest", F.lit(newest).cast("bigint"))
        append_batch(after.where(F.col("last") + ttl > F.col("newest") - late), batch_id, f"{path}/state")

    w = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(one)
    return (w.trigger(**trigger) if trigger else w).start()


def dedup_loose(events: DataFrame, key: str, ts: str = "ts", window: str = "5 minutes") -> DataFrame:
    """Seen-set form: no second row of a key inside the window."""
    return events.withWatermark(ts, window).dropDuplicatesWithinWatermark([key])


def forward_once(records: DataFrame, key: str = "number", ts: str = "created_at", keep_seconds: int = SEEN_SECONDS,
                 watermark: str = "5 minutes") -> DataFrame:
    """The first row of each key; its number stays seen until `keep_seconds` after it was last polled.

    The state is one instant per key, so a number that comes back long after the
    watermark has passed its first row is still known. Of the rows of a key in a
    micro-batch one is held at a time. An event-time timer frees the state."""
    fields = records.schema

    def step(k, frames: Iterator[pd.DataFrame], state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        first, last = None, state.get[0] if state.exists else 0
        for pdf in frames:
            at = pdf[ts].idxmin()
            if first is None or pdf.at[at, ts] < first[ts].iloc[0]:
                first = pdf.loc[[at]]
            last = max(last, int(pdf[ts].max().value // 1000))
        known = state.exists
        state.update((last,))
        state.setTimeoutTimestamp(max(last // 1000 + keep_seconds * 1000, state.getCurrentWatermarkMs() + 1))
        if not known:
            yield first

    return (records.withWatermark(ts, watermark).groupBy(key)
            .applyInPandasWithState(step, fields, "last bigint", "append", GroupStateTimeout.EventTimeTimeout))


def live_counters(events: DataFrame, active_at_start: int, bucket_minutes: int = 60, open_buckets: int = 48) -> DataFrame:
    """(bucket, completed_total, active) of each bucket that changes, as in the batch form.

    A task sends one row per bucket; only these meet at the one counter. Its state is
    the totals of the `open_buckets` newest buckets, and the sum of all before them: an
    event of an older bucket counts from the oldest open one on."""
    width = bucket_minutes * 60_000_000
    ended = list(RUN_OF_EVENT)

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done: Counter = Counter()
        all_ended: Counter = Counter()
        for pdf in frames:
            at = pdf["us"] // width
            done.update(at[pdf["event"] == "pipeline_complete"].tolist())
            all_ended.update(dict.fromkeys(at.tolist(), 0))
            all_ended.update(at[pdf["event"].isin(ended)].tolist())
        yield pd.DataFrame({"one": 0, "at": list(all_ended), "done": [done[b] for b in all_ended],
                            "ended": list(all_ended.values())})

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState):
        base, open_ = [0, 0], {}
        if state.exists:
            base, packed = [state.get[0], state.get[1]], state.get[2]
            open_ = {int(b): v for b, v in json.loads(packed).items()}
        changed = None
        oldest = min(open_) if len(open_) >= open_buckets else None
        for pdf in frames:
            for at, done, ended_ in zip(pdf["at"].tolist(), pdf["done"].tolist(), pdf["ended"].tolist(), strict=True):
                at = at if oldest is None else max(at, oldest)
                one = open_.setdefault(at, [0, 0])
                one[0] += done
                one[1] += ended_
                changed = at if changed is None else min(changed, at)
        rows, total = [], list(base)
        for at in sorted(open_):
            total = [total[0] + open_[at][0], total[1] + open_[at][1]]
            if changed is not None and at >= changed:
                rows.append((pd.Timestamp(at * width, unit="us"), total[0], max(0, active_at_start - total[1])))
        for at in sorted(open_)[:-open_buckets]:
            done, all_ended = open_.pop(at)
            base = [base[0] + done, base[1] + all_ended]
        state.update((*base, json.dumps(open_)))
        yield pd.DataFrame(rows, columns=["bucket", "completed_total", "active"])

    small = events.select(F.unix_micros("ts").alias("us"), "event").mapInPandas(partial, "one int, at bigint, done bigint, ended bigint")
    return small.groupBy("one").applyInPandasWithState(
        step, "bucket timestamp, completed_total bigint, active bigint", "done bigint, ended bigint, open string", "update",
        GroupStateTimeout.NoTimeout)


STEP_OF = {"agent_start": "running", "agent_done": "completed", "agent_error": "failed"}
RUN_OF = {"pipeline_started": "running", "pipeline_complete": "completed", "pipeline_error": "failed"}


def run_state(events: DataFrame, idle_seconds: int = IDLE_SECONDS, watermark: str = "10 minutes") -> DataFrame:
    """Run status and step states, updated as events arrive.

    Steps carry the times of their last start and end and their number of errors.
    An older event never replaces a newer state, of equal instants the larger event
    id wins, as in the batch fold; an idle run is closed and its state freed by an
    event-time timer."""
    out = ("run_id bigint, status string, agents array<struct<agent_num:int,status:string,started_us:bigint,"
           "completed_us:bigint,errors:bigint>>, last_event_us bigint, closed boolean")
    kept = "run_at bigint, run_id_at bigint, run_status string, agents string, seen bigint"

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState):
        # An agent is [instant, event id, status, started, completed, errors].
        run_at, run_event, run_status, agents, seen = (-1, -1, "running", {}, -1)
        if state.exists:
            run_at, run_event, run_status, packed, seen = state.get
            agents = {int(a): v for a, v in json.loads(packed).items()}

        def row(closed):
            return pd.DataFrame({
                "run_id": [key[0]], "status": [run_status],
                "agents": [[dict(zip(("agent_num", "status", "started_us", "completed_us", "errors"),
                                     (a, *agents[a][2:]), strict=True)) for a in sorted(agents)]],
                "last_event_us": [seen], "closed": [closed]})

        if state.hasTimedOut:
            state.remove()
            yield row(True)
            return
        for pdf in frames:
            for at, eid, ev, agent in zip(pdf["ts"], pdf["event_id"], pdf["event"], pdf["agent_num"]):
                us = int(at.value // 1000)
                seen = max(seen, us)
                if ev in STEP_OF:
                    one = agents.setdefault(int(agent), [-1, -1, "", None, None, 0])
                    if (us, int(eid)) >= (one[0], one[1]):
                        one[:3] = us, int(eid), STEP_OF[ev]
                    if ev == "agent_start":
                        one[3] = max(us, one[3] or us)
                    elif ev == "agent_done":
                        one[4] = max(us, one[4] or us)
                    else:
                        one[5] += 1
                elif ev in RUN_OF and (us, int(eid)) >= (run_at, run_event):
                    run_at, run_event, run_status = us, int(eid), RUN_OF[ev]
        state.update((run_at, run_event, run_status, json.dumps(agents), seen))
        due = seen // 1000 + idle_seconds * 1000
        state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        yield row(False)

    return (events.withWatermark("ts", watermark).groupBy("run_id")
            .applyInPandasWithState(step, out, kept, "update", GroupStateTimeout.EventTimeTimeout))


def retain_per_run(events: DataFrame, keep: int = KEEP_PER_RUN, expire_seconds: int = EXPIRE_SECONDS,
                   watermark: str = "10 minutes") -> DataFrame:
    """(run_id, event_id, ts, change): 1 for an entry that is kept from now on, -1 for one that no longer is.

    The entries whose changes sum to 1 are those the batch form keeps. The state of a
    run is at most `keep` pairs of instant and id; an event-time timer drops the
    entries of a run that was idle for `expire_seconds`."""
    def step(key, frames: Iterator[pd.DataFrame], state: GroupState):
        old = [tuple(e) for e in json.loads(state.get[0])] if state.exists else []
        if state.hasTimedOut:
            state.remove()
            new = []
        else:
            new = old
            for pdf in frames:
                came = zip((pdf["ts"].astype("datetime64[us]").astype("int64")).tolist(), pdf["event_id"].tolist(), strict=True)
                new = sorted({*new, *came}, reverse=True)[:keep]
            state.update((json.dumps(new),))
            due = new[0][0] // 1000 + expire_seconds * 1000
            state.setTimeoutTimestamp(max(due, state.getCurrentWatermarkMs() + 1))
        gone, came = set(old) - set(new), set(new) - set(old)
        rows = [(key[0], e, pd.Timestamp(us, unit="us"), c) for found, c in ((gone, -1), (came, 1)) for us, e in sorted(found)]
        yield pd.DataFrame(rows, columns=["run_id", "event_id", "ts", "change"])

    return (events.select("run_id", "event_id", "ts").withWatermark("ts", watermark).groupBy("run_id")
            .applyInPandasWithState(step, "run_id bigint, event_id bigint, ts timestamp, change int", "kept string", "append",
                                    GroupStateTimeout.EventTimeTimeout))


def volume(events: DataFrame, width: str = "1 hour", watermark: str = "10 minutes") -> DataFrame:
    """Completed and failed runs per tumbling window."""
    return (events.withWatermark("ts", watermark).groupBy(F.window("ts", width)).agg(
        F.count_if(F.col("event") == "pipeline_complete").alias("completed"),
        F.count_if(F.col("event").isin("pipeline_error", "agent_error")).alias("failed"))
        .select(F.col("window.start").alias("bucket"), "completed", "failed"))


def sink(events: DataFrame, path: str, checkpoint: str, mode: str = "append", **trigger):
    """Start an idempotent batch sink; `trigger` as in DataStreamWriter.trigger."""
    w = (events.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
         .foreachBatch(lambda df, n: append_batch(df, n, path)))
    return (w.trigger(**trigger) if trigger else w).start()


PROBLEM, TICKET = schemas.PROBLEM_EVENT, schemas.TICKET_EVENT
