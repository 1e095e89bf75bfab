"""Run, step and enrichment state; dashboard figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions import rules
from triagelake.operators.keyed import latest_per_key, merge_patches, running_sum

# ---- Fixed values: event to step state --------------------------------------
STEP_OF_EVENT = {"agent_start": "running", "agent_done": "completed", "agent_error": "failed"}
RUN_OF_EVENT = {"pipeline_complete": "completed", "pipeline_error": "failed"}
VIEW_OF_STEP = {"completed": "done", "failed": "error", "running": "running"}
AGENTS = [1, 2, 3, 4, 5, 6, 7]
# -----------------------------------------------------------------------------


def incident_upsert(changes: DataFrame, order: list[str], changed_at: str) -> DataFrame:
    """Whole-row overwrite per external id; created at the first change, updated at the last."""
    payload = [c for c in changes.columns if c not in ("external_id", *order)]
    return changes.groupBy("external_id").agg(
        F.max_by(F.struct(*payload), F.struct(*order)).alias("_row"),
        F.min(changed_at).alias("created_at"), F.max(changed_at).alias("updated_at")
    ).select("external_id", *[F.col(f"_row.{c}").alias(c) for c in payload],
             "created_at", "updated_at")


def step_upsert(log: DataFrame) -> DataFrame:
    return latest_per_key(log, ["run_id", "agent_num"], ["seq"])


def run_with_steps(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """Runs with their ordered steps; at most one step per agent, so the list stays short."""
    nested = steps.groupBy("run_id").agg(F.array_sort(F.collect_list(
        F.struct("agent_num", "status", "duration_ms"))).alias("steps"))
    return runs.join(nested, "run_id", "left").withColumn(
        "steps", F.coalesce("steps", F.array().cast(nested.schema["steps"].dataType)))


def newest_runs(runs: DataFrame, condition: Column, limit: int | None) -> DataFrame:
    out = runs.where(condition).orderBy(F.col("started_at").desc(), "run_id")
    return out if limit is None else out.limit(limit)


def active_runs(runs: DataFrame, limit: int = 50) -> DataFrame:
    return newest_runs(runs, F.col("status") == "running", limit)


def recent_runs(runs: DataFrame, as_of: Column, hours: int = 24, limit: int | None = 50) -> DataFrame:
    return newest_runs(runs, F.col("started_at") >= as_of - F.make_dt_interval(hours=F.lit(hours)),
                       limit)


def dashboard_metrics(runs: DataFrame, incidents: DataFrame, as_of: Column) -> DataFrame:
    """All figures from one pass over runs joined to the severity of their incident."""
    today = F.date_trunc("day", as_of)
    j = runs.join(incidents.select("external_id", "severity"), "external_id", "left")
    done = (F.col("status") == "completed") & (F.col("completed_at") >= today)
    running = F.col("status") == "running"
    a = j.agg(F.count_if(running).alias("active"),
              F.count_if(done).alias("completed_today"),
              F.coalesce(F.bround(F.avg(F.when(done, F.col("duration_ms")))), F.lit(0.0))
               .cast("bigint").alias("avg_duration_ms"),
              F.count_if(running & (F.col("severity") == "P1")).alias("p1_open"),
              F.count_if(F.col("started_at") >= today).alias("_started"))
    rate = F.when(F.col("_started") > 0,
                  F.bround(100 * F.col("completed_today") / F.col("_started")).cast("bigint")
                  ).otherwise(F.lit(100).cast("bigint"))
    return a.withColumn("success_rate", rate).drop("_started")


def enrichment_pivot(enrichments: DataFrame, sources: list[str], order: list[str]) -> DataFrame:
    """Latest enrichment per source as one wide row per run."""
    seq = F.struct(*order)
    return enrichments.groupBy("run_id").agg(*[
        F.max_by("data", F.when(F.col("source") == s, seq)).alias(s) for s in sources])


def context_merge(patches: DataFrame, order: list[str]) -> DataFrame:
    """Shallow merge: the last value per (run, entry key), as a map per run."""
    entries = patches.select("run_id", *order, F.explode("patch").alias("entry", "value"))
    last = entries.groupBy("run_id", "entry").agg(
        F.max_by("value", F.struct(*order)).alias("value"))
    return last.groupBy("run_id").agg(F.map_from_entries(F.array_sort(
        F.collect_list(F.struct("entry", "value")))).alias("context"))


def fold_steps(events: DataFrame) -> DataFrame:
    """Step state per (run, agent): the status of the last step event and its times."""
    seq = F.struct("ts", "event_id")
    ev = F.col("event")
    st = rules.lookup(ev, STEP_OF_EVENT)
    return (events.where(ev.isin(list(STEP_OF_EVENT)))
            .groupBy("run_id", "agent_num").agg(
                F.max_by(st, seq).alias("status"),
                F.max(F.when(ev == "agent_start", F.col("ts"))).alias("started_at"),
                F.max(F.when(ev == "agent_done", F.col("ts"))).alias("completed_at"),
                F.count_if(ev == "agent_error").alias("errors")))


def fold_runs(events: DataFrame) -> DataFrame:
    """Run status: the last terminal event wins, running when there is none.

    A new start event opens the run again."""
    ev, seq = F.col("event"), F.struct("ts", "event_id")
    status = rules.lookup(ev, {**RUN_OF_EVENT, "pipeline_started": "running"})
    return events.groupBy("run_id").agg(
        F.coalesce(F.max_by(status, F.when(status.isNotNull(), seq)), F.lit("running"))
         .alias("status"),
        F.max("ts").alias("last_event_at"))


def live_counters(events: DataFrame, active_at_start: int, bucket_minutes: int = 60) -> DataFrame:
    """Completed and active counts at the end of each time bucket.

    Every terminal event takes one from `active`, which never falls below zero.
    Nothing adds to it, so the clamped walk equals max(0, start - terminal events
    so far), and a running sum over the bucket totals is enough: one row per
    bucket, however many events there are.
    """
    width = bucket_minutes * 60
    bucket = F.timestamp_seconds(F.floor(F.unix_seconds("ts") / width) * width)
    per = events.groupBy(bucket.alias("bucket")).agg(
        F.count_if(F.col("event") == "pipeline_complete").alias("done"),
        F.count_if(F.col("event").isin(list(RUN_OF_EVENT))).alias("ended"))
    days = per.withColumn("_all", F.lit(0)).withColumn("_day", F.to_date("bucket"))
    s = running_sum(days, ["_all"], "_day", [F.col("bucket")], "done", "completed_total")
    s = running_sum(s, ["_all"], "_day", [F.col("bucket")], "ended", "_ended")
    return s.select("bucket", "completed_total",
                    F.greatest(F.lit(0), F.lit(active_at_start) - F.col("_ended")).alias("active"))


def report_stats(runs: DataFrame) -> DataFrame:
    done = F.col("status") == "completed"
    mean = F.avg(F.when(done, F.coalesce("duration_ms", F.lit(0))))
    return runs.agg(
        F.count("*").alias("total"), F.count_if(done).alias("completed"),
        F.count_if(F.col("status") == "failed").alias("failed"),
        F.count_if(F.col("flow") == "primary").alias("primary_runs"),
        F.coalesce(rules.round_half_up_js(mean), F.lit(0)).cast("bigint").alias("avg_duration_ms"),
        F.when(F.count("*") > 0, rules.round_half_up_js(
            100 * F.count_if(done) / F.count("*"))).otherwise(100).cast("bigint")
         .alias("success_rate"))


def bucket_count(hours: int) -> int:
    return 6 if hours <= 6 else 24 if hours <= 24 else 14


def volume_buckets(runs: DataFrame, as_of: Column, hours: int) -> DataFrame:
    """Completed and failed runs and mean seconds per time bucket; empty buckets stay."""
    n = bucket_count(hours)
    width = hours * 3_600_000_000 // n
    age = F.unix_micros(as_of) - F.unix_micros("started_at")
    slot = (n - 1 - F.floor(age / width)).cast("int")
    done = F.col("status") == "completed"
    dur = F.when(done & (F.col("duration_ms") > 0), F.col("duration_ms"))
    agg = (runs.where((age >= 0) & (age < hours * 3_600_000_000))
           .groupBy(slot.alias("bucket")).agg(
               F.count_if(done).alias("completed"),
               F.count_if(F.col("status") == "failed").alias("failed"),
               F.coalesce(rules.round_half_up_js(F.avg(dur) / 1000), F.lit(0)).alias("avg_seconds")))
    spine = runs.sparkSession.range(n).select(F.col("id").cast("int").alias("bucket"))
    return spine.join(agg, "bucket", "left").select(
        "bucket", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
                    for c in ("completed", "failed", "avg_seconds")])


def severity_breakdown(runs: DataFrame, incidents: DataFrame) -> DataFrame:
    j = runs.join(incidents.select("external_id", "severity"), "external_id", "left")
    return j.groupBy(F.coalesce("severity", F.lit("unknown")).alias("severity")).agg(
        F.count("*").alias("n"))


def agent_grid(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """State of agents 1..7 per run as columns, and the first running agent."""
    state = rules.lookup(F.col("status"), VIEW_OF_STEP, "idle")
    by_run = steps.groupBy("run_id").agg(
        *[F.max(F.when(F.col("agent_num") == a, state)).alias(f"a{a}") for a in AGENTS],
        F.min(F.when(F.col("status") == "running", F.col("agent_num"))).alias("current_agent"))
    return runs.select("run_id").join(by_run, "run_id", "left").select(
        "run_id", *[F.coalesce(f"a{a}", F.lit("idle")).alias(f"a{a}") for a in AGENTS],
        "current_agent")


def apply_run_patches(log: DataFrame, fields: list[str], order: list[str]) -> DataFrame:
    return merge_patches(log, ["run_id"], fields, order)


def valid_resolutions(resolutions: DataFrame) -> tuple[DataFrame, DataFrame]:
    ok = F.col("confidence").between(0, 100) & F.col("rating").between(1, 5)
    return resolutions.where(ok), resolutions.where(~F.coalesce(ok, F.lit(False)))


def rating_by_category(resolutions: DataFrame) -> DataFrame:
    good, _ = valid_resolutions(resolutions)
    return good.groupBy("root_cause_cat").agg(
        F.count("*").alias("n"), F.round(F.avg("rating"), 6).alias("avg_rating"),
        F.round(F.avg("confidence"), 6).alias("avg_confidence"))


def root_cause_top(resolutions: DataFrame, runs: DataFrame, incidents: DataFrame, severity: str,
                   as_of: Column, days: int = 7, k: int = 5) -> DataFrame:
    """Most common root causes of incidents of one severity in the last days."""
    recent = runs.where(F.col("started_at") >= as_of - F.make_dt_interval(days=F.lit(days)))
    sev = incidents.where(F.col("severity") == severity).select("external_id")
    j = (resolutions.join(recent.select("run_id", "external_id", "duration_ms"), "run_id")
                    .join(sev, "external_id", "left_semi"))
    return (j.groupBy("root_cause_cat").agg(F.count("*").alias("n"),
                                            F.round(F.avg("duration_ms"), 6).alias("avg_duration_ms"))
             .orderBy(F.col("n").desc(), "root_cause_cat").limit(k))


def sla_breaches(runs: DataFrame, incidents: DataFrame, as_of: Column, hours: int = 24) -> DataFrame:
    """Runs past their deadline per service: finished late, or open at the as-of instant."""
    recent = runs.where(F.col("started_at") >= as_of - F.make_dt_interval(hours=F.lit(hours)))
    j = recent.join(incidents.select("external_id", "severity", "service"), "external_id")
    due = rules.sla_deadline(F.col("started_at"), F.col("severity"))
    late = F.coalesce("completed_at", as_of) > due
    return j.groupBy("service").agg(F.count("*").alias("runs"),
                                    F.count_if(due.isNotNull()).alias("with_deadline"),
                                    F.count_if(late).alias("breached"))


def chat_context(runs: DataFrame, incidents: DataFrame, as_of: Column) -> DataFrame:
    """Severity summary of the last day with running counts (rows of a chat briefing)."""
    recent = runs.where(F.col("started_at") >= as_of - F.make_dt_interval(days=F.lit(1)))
    j = recent.join(incidents.select("external_id", "severity"), "external_id", "left")
    return j.groupBy(F.coalesce("severity", F.lit("unknown")).alias("severity")).agg(
        F.count("*").alias("incidents"), F.count_if(F.col("status") == "running").alias("active"))
