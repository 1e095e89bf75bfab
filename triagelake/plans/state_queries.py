"""Queries: logs, run state, dashboard, chat."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake.functions import rules
from triagelake.operators import chat, loganalysis, runstate
from triagelake.plans import sqltext as S
from triagelake.plans.registry import query
from triagelake.plans.routing_queries import text_ts
from triagelake.sources import domain as D

NOW = D.AS_OF

# ---- logs -------------------------------------------------------------------


@query(f"""WITH {S.LOGS} SELECT level, count(*) AS n FROM logs
  WHERE regexp_matches(level || ' ' || content, '(?i)\\b(?:ERROR|WARN|CRITICAL|Exception|Traceback|timeout)\\b')
  AND ts >= TIMESTAMP '2024-01-10' AND ts <= TIMESTAMP '2024-01-20' GROUP BY level ORDER BY n DESC, level LIMIT 20""")
def log_level_top(spark, sf):
    return loganalysis.level_top(D.logs(spark, sf), rules.LOG_KEYWORDS + ["timeout"],
                                 D.ts("2024-01-10 00:00:00"), D.ts("2024-01-20 00:00:00"))


@query(f"""WITH {S.LOGS}, {S.INC} SELECT external_id, event_id, level, rank FROM (SELECT external_id, event_id, level,
    CAST(row_number() OVER (PARTITION BY external_id ORDER BY ts DESC, event_id DESC) AS INT) AS rank
  FROM inc JOIN logs ON inc.entity = logs.entity AND level IN ('ERROR','WARN','SEVERE')
    AND ts BETWEEN opened_at - INTERVAL 15 MINUTE AND opened_at + INTERVAL 15 MINUTE) WHERE rank <= 50""")
def log_window_join(spark, sf):
    return loganalysis.log_window_join(D.incident_core(spark, sf), D.logs(spark, sf)).select(
        "external_id", "event_id", "level", "rank")


@query(f"""WITH {S.LOGS}, {S.INC} SELECT external_id, event_id, rank FROM (SELECT external_id, event_id,
    CAST(row_number() OVER (PARTITION BY external_id ORDER BY ts DESC, event_id DESC) AS INT) AS rank
  FROM inc JOIN logs ON inc.entity = logs.entity AND level IN ('ERROR','WARN','SEVERE')
    AND regexp_matches(content, '(?i)\\b(?:connection timeout|oom)\\b')
    AND ts BETWEEN opened_at - INTERVAL 12 HOUR AND opened_at + INTERVAL 12 HOUR) WHERE rank <= 3""")
def log_window_keywords(spark, sf):
    """A day-wide window with phrases and a low limit, so that the limit takes effect."""
    return loganalysis.log_window_join(
        D.incident_core(spark, sf), D.logs(spark, sf), minutes=720, limit=3,
        keywords=["connection timeout", "oom"]).select("external_id", "event_id", "rank")


LOOKBACK = """CASE severity WHEN 'P1' THEN 15 WHEN 'P2' THEN 30 WHEN 'P3' THEN 30 ELSE 60 END"""
ANALYSED = f"""{S.LOGS}, {S.INC}, hit AS (SELECT external_id, level, content FROM inc JOIN logs ON inc.entity = logs.entity
    AND ts BETWEEN opened_at - to_minutes({LOOKBACK}) AND opened_at),
  tot AS (SELECT external_id, count(*) AS scanned, count(*) FILTER (level = 'ERROR') AS errors,
    count(*) FILTER (level = 'WARN') AS warnings FROM hit GROUP BY 1),
  msg AS (SELECT external_id, string_agg(content, ' ' ORDER BY rn) AS top FROM (SELECT external_id, content,
    row_number() OVER (PARTITION BY external_id ORDER BY count(*) DESC, content) AS rn FROM hit GROUP BY 1, 2) WHERE rn <= 5 GROUP BY 1),
  ana AS (SELECT inc.*, coalesce(scanned,0) AS scanned, coalesce(errors,0) AS errors, coalesce(warnings,0) AS warnings,
    coalesce(top,'') AS top_errors, CASE WHEN top LIKE '%connection%' OR top LIKE '%timeout%' THEN 'db_connection'
    WHEN top LIKE '%memory%' OR top LIKE '%oom%' OR top LIKE '%heap%' THEN 'memory'
    WHEN top LIKE '%deploy%' OR top LIKE '%classnot%' THEN 'deployment' WHEN errors > 100 THEN 'high_error_rate' ELSE 'unknown' END AS classification
    FROM inc LEFT JOIN tot USING (external_id) LEFT JOIN msg USING (external_id))"""


@query(f"WITH {ANALYSED} SELECT external_id, scanned, errors, warnings FROM ana")
def log_error_warn_counts(spark, sf):
    inc = D.incident_core(spark, sf)
    tot = loganalysis.log_totals(loganalysis.incident_log_counts(inc, D.logs(spark, sf)))
    return inc.select("external_id").join(tot, "external_id", "left").select(
        "external_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("scanned", "errors", "warnings")])


@query(f"WITH {ANALYSED} SELECT external_id, top_errors, classification FROM ana")
def classify_errors(spark, sf):
    a = loganalysis.analyse_logs(D.incident_core(spark, sf), D.logs(spark, sf))
    return a.select("external_id", F.array_join("top_errors", " ").alias("top_errors"), "classification")


@query(f"""WITH {ANALYSED} SELECT external_id, 'Found ' || errors || ' errors and ' || warnings || ' warnings over last '
  || {LOOKBACK} || 'min.' AS summary FROM ana""")
def log_summary_text(spark, sf):
    return loganalysis.analyse_logs(D.incident_core(spark, sf), D.logs(spark, sf)).select(
        "external_id", "summary")


@query(f"""WITH {ANALYSED}, {S.RUNS} SELECT classification, count(*) AS incidents, CAST(sum(errors) AS BIGINT) AS errors,
  round(avg(duration_ms), 3) AS avg_duration_ms FROM ana JOIN runs USING (external_id) WHERE severity = 'P1'
  GROUP BY classification""")
def p1_class_report(spark, sf):
    """Most common error classes of P1 incidents and how fast they were handled."""
    p1 = D.incident_core(spark, sf).where(F.col("severity") == "P1")
    a = loganalysis.analyse_logs(p1, D.logs(spark, sf))
    runs = D.runs(spark, sf).select("external_id", "duration_ms")
    return (a.join(runs, "external_id").groupBy("classification").agg(
        F.count("*").alias("incidents"), F.sum("errors").alias("errors"),
        F.round(F.avg("duration_ms"), 3).alias("avg_duration_ms")))


# ---- run state ---------------------------------------------------------------

CHANGE_ORDER = ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]


@query("""SELECT printf('INC%07d', l_orderkey) AS external_id, title, host, strftime(c, '%Y-%m-%d') AS created_on,
  strftime(u, '%Y-%m-%d') AS updated_on FROM (SELECT l_orderkey, 'part ' || l_partkey AS title,
    CASE WHEN l_returnflag <> 'R' THEN 'host-' || l_suppkey END AS host,
    min(l_shipdate) OVER (PARTITION BY l_orderkey) AS c, max(l_shipdate) OVER (PARTITION BY l_orderkey) AS u,
    row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey DESC,
      l_suppkey DESC, l_extendedprice DESC) AS rn FROM lineitem) WHERE rn = 1""")
def incident_upsert(spark, sf):
    ch = D.table(spark, sf, "lineitem").select(
        D.ticket_no(F.col("l_orderkey")).alias("external_id"), *CHANGE_ORDER,
        F.concat(F.lit("part "), "l_partkey").alias("title"),
        F.when(F.col("l_returnflag") != "R", F.concat(F.lit("host-"), "l_suppkey")).alias("host"))
    up = runstate.incident_upsert(ch, CHANGE_ORDER, "l_shipdate")
    return up.select("external_id", "title", "host", F.date_format("created_at", "yyyy-MM-dd").alias("created_on"),
                     F.date_format("updated_at", "yyyy-MM-dd").alias("updated_on"))


@query(f"WITH {S.STEPS} SELECT run_id, agent_num, status, duration_ms FROM steps")
def step_upsert(spark, sf):
    return runstate.step_upsert(D.step_log(spark, sf)).select("run_id", "agent_num", "status", "duration_ms")


@query(f"""WITH {S.STEPS}, {S.RUNS} SELECT run_id, status, coalesce(steps, '') AS steps FROM runs LEFT JOIN
  (SELECT run_id, string_agg(agent_num || ':' || status, ',' ORDER BY agent_num) AS steps FROM steps GROUP BY 1) USING (run_id)""")
def run_with_steps(spark, sf):
    r = runstate.run_with_steps(D.runs(spark, sf).select("run_id", "status"),
                                runstate.step_upsert(D.step_log(spark, sf)))
    flat = F.transform("steps", lambda s: F.concat(s["agent_num"].cast("string"), F.lit(":"), s["status"]))
    return r.select("run_id", "status", F.array_join(flat, ",").alias("steps"))


@query(f"WITH {S.INC} SELECT external_id, severity, service, team FROM inc WHERE incident_key = 42")
def incident_lookup(spark, sf):
    return D.incidents(spark, sf).where(F.col("incident_key") == 42).select(
        "external_id", "severity", "service", "team")


@query(f"WITH {S.RUNS} SELECT run_id, external_id, status, duration_ms FROM runs WHERE run_id = 42")
def run_lookup(spark, sf):
    return D.runs(spark, sf).where(F.col("run_id") == 42).select("run_id", "external_id", "status", "duration_ms")


@query(f"""WITH {S.RUNS} SELECT run_id, external_id, status, flow, {S.fmt('started_at')} AS started_at,
  {S.fmt('completed_at')} AS completed_at, duration_ms FROM runs""")
def run_summary(spark, sf):
    return text_ts(D.runs(spark, sf), "started_at", "completed_at")


@query(f"""WITH {S.RUNS} SELECT run_id, {S.fmt('started_at')} AS started_at FROM runs WHERE status = 'running'
  ORDER BY runs.started_at DESC, run_id LIMIT 50""")
def active_runs(spark, sf):
    return text_ts(runstate.active_runs(D.runs(spark, sf)).select("run_id", "started_at"), "started_at")


@query(f"""WITH {S.RUNS} SELECT run_id, status FROM runs WHERE started_at >= {S.AS_OF} - INTERVAL 24 HOUR
  ORDER BY started_at DESC, run_id LIMIT 50""")
def recent_runs(spark, sf):
    return runstate.recent_runs(D.runs(spark, sf), D.ts(NOW)).select("run_id", "status")


@query(f"""WITH {S.RUNS}, {S.INC}, j AS (SELECT runs.*, severity FROM runs LEFT JOIN inc USING (external_id)),
  t AS (SELECT TIMESTAMP '2024-01-30' AS today)
  SELECT count(*) FILTER (status = 'running') AS active,
    count(*) FILTER (status = 'completed' AND completed_at >= today) AS completed_today,
    CAST(round_even(coalesce(avg(duration_ms) FILTER (status = 'completed' AND completed_at >= today), 0), 0) AS BIGINT) AS avg_duration_ms,
    count(*) FILTER (status = 'running' AND severity = 'P1') AS p1_open,
    CASE WHEN count(*) FILTER (started_at >= today) > 0 THEN CAST(round_even(100.0 * count(*) FILTER (status = 'completed' AND completed_at >= today)
      / count(*) FILTER (started_at >= today), 0) AS BIGINT) ELSE 100 END AS success_rate FROM j, t""")
def dashboard_metrics(spark, sf):
    return runstate.dashboard_metrics(D.runs(spark, sf), D.incident_core(spark, sf), D.ts("2024-01-30 18:00:00"))


SOURCES = ["view", "click", "error", "human_feedback"]


@query("""SELECT user_id AS run_id, arg_max(props, event_id) FILTER (event_type = 'view') AS "view",
  arg_max(props, event_id) FILTER (event_type = 'click') AS click, arg_max(props, event_id) FILTER (event_type = 'error') AS error,
  arg_max(props, event_id) FILTER (event_type IN ('signup','purchase')) AS human_feedback FROM events GROUP BY 1""")
def enrichment_pivot(spark, sf):
    e = D.table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), "event_id", F.col("props").alias("data"),
        F.when(F.col("event_type").isin("signup", "purchase"), "human_feedback")
         .otherwise(F.col("event_type")).alias("source"))
    return runstate.enrichment_pivot(e, SOURCES, ["event_id"])


@query("""SELECT run_id, string_agg(entry || '=' || v, ',' ORDER BY entry) AS context FROM (SELECT user_id AS run_id,
  event_type AS entry, arg_max(props, event_id) AS v FROM events GROUP BY 1, 2) GROUP BY 1""")
def context_merge(spark, sf):
    p = D.table(spark, sf, "events").select(
        F.col("user_id").alias("run_id"), "event_id", F.create_map("event_type", "props").alias("patch"))
    flat = F.transform(F.map_entries("context"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return runstate.context_merge(p, ["event_id"]).select("run_id", F.array_join(flat, ",").alias("context"))


@query(f"""WITH {S.REVENTS} SELECT run_id, agent_num, arg_max(CASE event WHEN 'agent_start' THEN 'running'
    WHEN 'agent_done' THEN 'completed' ELSE 'failed' END, (ts, event_id)) AS status,
  {S.fmt("max(ts) FILTER (event = 'agent_start')")} AS started_at, {S.fmt("max(ts) FILTER (event = 'agent_done')")} AS completed_at,
  count(*) FILTER (event = 'agent_error') AS errors
  FROM rev WHERE event IN ('agent_start','agent_done','agent_error') GROUP BY 1, 2""")
def run_state_fold(spark, sf):
    return text_ts(runstate.fold_steps(D.run_events(spark, sf)), "started_at", "completed_at")


@query(f"""WITH {S.REVENTS} SELECT run_id, coalesce(arg_max(CASE event WHEN 'pipeline_complete' THEN 'completed'
  WHEN 'pipeline_started' THEN 'running' END, (ts, event_id)) FILTER (event IN ('pipeline_complete','pipeline_started')), 'running') AS status
  FROM rev GROUP BY 1""")
def run_status_fold(spark, sf):
    return runstate.fold_runs(D.run_events(spark, sf)).select("run_id", "status")


@query(f"""WITH {S.REVENTS}, h AS (SELECT date_trunc('hour', ts) AS bucket, count(*) FILTER (event = 'pipeline_complete') AS done
  FROM rev GROUP BY 1) SELECT {S.fmt('bucket')} AS bucket, CAST(sum(done) OVER (ORDER BY h.bucket) AS BIGINT) AS completed_total,
  CAST(greatest(0, 1000 - sum(done) OVER (ORDER BY h.bucket)) AS BIGINT) AS active FROM h""")
def live_counters(spark, sf):
    return text_ts(runstate.live_counters(D.run_events(spark, sf), 1000), "bucket")


@query(f"""WITH {S.RUNS} SELECT count(*) AS total, count(*) FILTER (status = 'completed') AS completed,
  count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (flow = 'primary') AS primary_runs,
  CAST(floor(avg(duration_ms) FILTER (status = 'completed') + 0.5) AS BIGINT) AS avg_duration_ms,
  CAST(floor(100.0 * count(*) FILTER (status = 'completed') / count(*) + 0.5) AS BIGINT) AS success_rate
  FROM runs WHERE started_at >= {S.AS_OF} - INTERVAL 168 HOUR""")
def report_stats(spark, sf):
    return runstate.report_stats(runstate.recent_runs(D.runs(spark, sf), D.ts(NOW), 168, None))


def _buckets_sql(hours: int, n: int) -> str:
    w = hours * 3_600_000_000 // n
    return f"""WITH {S.RUNS}, b AS (SELECT {n - 1} - CAST(floor((epoch_us({S.AS_OF}) - epoch_us(started_at)) / {w}.0) AS INT) AS bucket,
    status, duration_ms FROM runs WHERE started_at <= {S.AS_OF}),
  s AS (SELECT CAST(unnest(range({n})) AS INT) AS bucket)
  SELECT s.bucket, count(*) FILTER (status = 'completed') AS completed, count(*) FILTER (status = 'failed') AS failed,
    CAST(coalesce(floor(avg(duration_ms) FILTER (status = 'completed' AND duration_ms > 0) / 1000 + 0.5), 0) AS BIGINT) AS avg_seconds
  FROM s LEFT JOIN b USING (bucket) GROUP BY 1"""


@query(_buckets_sql(168, 14))
def volume_buckets(spark, sf):
    return runstate.volume_buckets(D.runs(spark, sf), D.ts(NOW), 168)


@query(_buckets_sql(6, 6))
def volume_buckets_6h(spark, sf):
    return runstate.volume_buckets(D.runs(spark, sf), D.ts(NOW), 6)


@query(_buckets_sql(24, 24))
def volume_buckets_24h(spark, sf):
    return runstate.volume_buckets(D.runs(spark, sf), D.ts(NOW), 24)


@query(f"WITH {S.RUNS}, {S.INC} SELECT coalesce(severity, 'unknown') AS severity, count(*) AS n FROM runs LEFT JOIN inc USING (external_id) GROUP BY 1")
def severity_breakdown(spark, sf):
    return runstate.severity_breakdown(D.runs(spark, sf), D.incident_core(spark, sf))


_VIEW = "CASE status WHEN 'completed' THEN 'done' WHEN 'failed' THEN 'error' WHEN 'running' THEN 'running' ELSE 'idle' END"


@query(f"""WITH {S.RUNS}, {S.STEPS}, g AS (SELECT run_id, """
       + ", ".join(f"max({_VIEW}) FILTER (agent_num = {a}) AS a{a}" for a in range(1, 8))
       + """, min(agent_num) FILTER (status = 'running') AS current_agent FROM steps GROUP BY 1)
  SELECT run_id, """ + ", ".join(f"coalesce(a{a}, 'idle') AS a{a}" for a in range(1, 8))
       + ", current_agent FROM runs LEFT JOIN g USING (run_id)")
def agent_grid(spark, sf):
    return runstate.agent_grid(D.runs(spark, sf), runstate.step_upsert(D.step_log(spark, sf)))


@query("""SELECT l_orderkey AS run_id, arg_max(CASE l_returnflag WHEN 'A' THEN 'completed' ELSE 'running' END,
    (l_shipdate, l_partkey, l_suppkey, l_extendedprice)) FILTER (l_returnflag <> 'R') AS status,
  arg_max(CAST(l_quantity*1000 AS BIGINT), (l_shipdate, l_partkey, l_suppkey, l_extendedprice)) FILTER (l_quantity <= 25) AS duration_ms
  FROM lineitem GROUP BY 1""")
def apply_run_patches(spark, sf):
    log = D.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), *D.STEP_SEQ,
        rules.lookup(F.col("l_returnflag"), {"A": "completed", "N": "running"}).alias("status"),
        F.when(F.col("l_quantity") <= 25, (F.col("l_quantity") * 1000).cast("bigint")).alias("duration_ms"))
    return runstate.apply_run_patches(log, ["status", "duration_ms"], D.STEP_SEQ)


RES = """res AS (SELECT o_orderkey AS run_id, CASE o_orderkey % 6 WHEN 0 THEN 'db_connection' WHEN 1 THEN 'memory'
  WHEN 2 THEN 'deployment' WHEN 3 THEN 'network' WHEN 4 THEN 'config' ELSE 'unknown' END AS root_cause_cat,
  CAST(trunc(o_totalprice) AS BIGINT) % 111 AS confidence, o_orderkey % 7 AS rating FROM orders WHERE o_orderstatus <> 'P')"""


@query(f"""WITH {RES} SELECT root_cause_cat, count(*) AS n, round(avg(rating), 6) AS avg_rating, round(avg(confidence), 6) AS avg_confidence
  FROM res WHERE confidence BETWEEN 0 AND 100 AND rating BETWEEN 1 AND 5 GROUP BY 1""")
def rating_by_category(spark, sf):
    return runstate.rating_by_category(D.resolutions(spark, sf))


@query(f"""WITH {RES}, {S.RUNS}, {S.INC} SELECT root_cause_cat, count(*) AS n, round(avg(duration_ms), 6) AS avg_duration_ms
  FROM res JOIN runs USING (run_id) JOIN inc USING (external_id) WHERE severity = 'P1'
  AND started_at >= {S.AS_OF} - INTERVAL 7 DAY GROUP BY 1 ORDER BY n DESC, 1 LIMIT 5""")
def root_cause_top(spark, sf):
    return runstate.root_cause_top(D.resolutions(spark, sf), D.runs(spark, sf), D.incident_core(spark, sf),
                                   "P1", D.ts(NOW))


@query(f"""WITH {S.RUNS}, {S.INC}, j AS (SELECT service, coalesce(completed_at, {S.AS_OF}) AS done, CASE severity
    WHEN 'P1' THEN started_at + INTERVAL 15 MINUTE WHEN 'P2' THEN started_at + INTERVAL 60 MINUTE
    WHEN 'P3' THEN started_at + INTERVAL 240 MINUTE END AS due FROM runs JOIN inc USING (external_id)
    WHERE started_at >= {S.AS_OF} - INTERVAL 24 HOUR)
  SELECT service, count(*) AS runs, count(due) AS with_deadline, count(*) FILTER (done > due) AS breached FROM j GROUP BY 1""")
def sla_breaches(spark, sf):
    return runstate.sla_breaches(D.runs(spark, sf), D.incidents(spark, sf), D.ts(NOW))


@query(f"""WITH {S.RUNS}, {S.INC} SELECT severity, count(*) AS incidents, count(*) FILTER (status = 'running') AS active
  FROM runs JOIN inc USING (external_id) WHERE started_at >= {S.AS_OF} - INTERVAL 24 HOUR GROUP BY 1""")
def chat_context(spark, sf):
    return runstate.chat_context(D.runs(spark, sf), D.incident_core(spark, sf), D.ts(NOW))


@query("""SELECT doc, max(ts_) AS last_access FROM (SELECT 'doc-' || user_id AS doc, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts_
  FROM events WHERE event_type = 'view') GROUP BY 1 ORDER BY last_access DESC, doc LIMIT 5""")
def chat_recent_documents(spark, sf):
    """Documents by most recent access (views), five newest."""
    e = D.table(spark, sf, "events").where(F.col("event_type") == "view")
    a = e.groupBy(F.concat(F.lit("doc-"), "user_id").alias("doc")).agg(F.max("ts").alias("last_access"))
    return text_ts(a, "last_access").orderBy(F.col("last_access").desc(), "doc").limit(5)


# ---- chat -------------------------------------------------------------------

@query("""SELECT user_id, event_type AS title, event_id, value, CASE WHEN value/100 >= 0.85 THEN 'Strong match'
  WHEN value/100 >= 0.70 THEN 'Likely match' ELSE 'Weak match' END AS label FROM events
  QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) = 1""")
def rank_citations(spark, sf):
    c = D.table(spark, sf, "events").select(
        "user_id", F.col("event_type").alias("title"), "event_id", "value",
        (F.col("value") / 100).alias("score"))
    return chat.rank_citations(c, "user_id", "title", "score", "event_id").drop("score")


@query("""SELECT conv_id, turn, tokens, used FROM (SELECT conv_id, turn, CAST(ceil(length(text)/4.0) AS BIGINT) AS tokens,
  CAST(sum(CAST(ceil(length(text)/4.0) AS BIGINT)) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used
  FROM conversations) WHERE used <= 300""")
def trim_history(spark, sf):
    """A budget of 300 tokens, below the size of the test conversations."""
    return chat.trim_history(D.conversations(spark, sf), 300, slice_turns=2).select(
        "conv_id", "turn", "tokens", "used")


@query("""SELECT conv_id, CASE WHEN t IS NULL THEN 'New conversation' WHEN length(t) > 48 THEN left(t, 48) || '…' ELSE t END AS title
  FROM (SELECT conv_id, arg_min(text, turn) FILTER (role = 'user') AS t FROM conversations GROUP BY 1)""")
def session_titles(spark, sf):
    return chat.session_titles(D.conversations(spark, sf))
