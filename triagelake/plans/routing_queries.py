"""Queries: sources, filters, classification, routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake.functions import rules
from triagelake.operators import routing
from triagelake.plans import sqltext as S
from triagelake.plans.registry import query
from triagelake.sources import domain as D
from triagelake.sources import readers, sinks


def stamp(c):
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def text_ts(df, *cols):
    return df.withColumns({c: stamp(F.col(c)) for c in cols})


@query("""SELECT printf('INC%07d', o_orderkey) AS number, o_orderpriority AS short_description,
  o_orderstatus AS state, strftime(o_orderdate, '%Y-%m-%d') AS closed_on FROM orders
  WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1996-02-01'""")
def closed_incident_scan(spark, sf):
    o = D.table(spark, sf, "orders")
    hit = readers.closed_incident_scan(o, "1996-01-01", "1996-01-31", "o_orderstatus", "o_orderdate", closed="F")
    return hit.select(D.ticket_no(F.col("o_orderkey")).alias("number"),
                      F.col("o_orderpriority").alias("short_description"),
                      F.col("o_orderstatus").alias("state"),
                      F.date_format("o_orderdate", "yyyy-MM-dd").alias("closed_on"))


@query(f"""WITH {S.INC} SELECT external_id AS number, CASE WHEN incident_key % 11 = 0 THEN '4' ELSE priority END AS priority,
  coalesce(service, '') AS cmdb_ci, '1' AS state, {S.fmt('opened_at')} AS created_at FROM inc
  WHERE opened_at >= TIMESTAMP '2024-01-15 10:00:00' AND opened_at <= TIMESTAMP '2024-01-15 12:00:00'
    AND incident_key % 3 <> 0""")
def poll_recent_incidents(spark, sf):
    i = D.incidents(spark, sf)
    pair = lambda v: F.struct(v.alias("value"), v.alias("display_value"))          # noqa: E731
    rec = i.select(F.col("external_id").alias("number"), F.col("opened_at").alias("created_at"),
                   F.when(F.col("incident_key") % 11 != 0, pair(F.col("priority"))).alias("priority"),
                   F.lit(None).cast("string").alias("short_description"),
                   pair(F.lit(None).cast("string")).alias("caller_id"), pair(F.col("service")).alias("cmdb_ci"),
                   pair(F.lit(None).cast("string")).alias("state"))
    out = readers.poll_recent(rec, D.ts("2024-01-15 12:00:00"), minutes=120,
                              seen=i.where("incident_key % 3 = 0").select(F.col("external_id").alias("number")))
    return text_ts(out.select("number", "priority", "cmdb_ci", "state", "created_at"), "created_at")


@query(f"""WITH {S.INC}, target AS (SELECT external_id, 'servicenow' AS source, severity, 'stored' AS title FROM inc
    JOIN orders ON o_orderkey = incident_key WHERE o_orderstatus = 'F'),
  legacy AS (SELECT external_id, 'dynatrace' AS source, CASE WHEN flow = 'primary' THEN severity ELSE 'P3' END AS severity, '' AS title FROM inc)
  SELECT * FROM target UNION ALL SELECT * FROM legacy WHERE external_id NOT IN (SELECT external_id FROM target)""")
def import_if_absent(spark, sf):
    i = D.incident_core(spark, sf)
    done = D.table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(
        F.col("o_orderkey").alias("incident_key"))
    target = i.join(done, "incident_key", "left_semi").select(
        "external_id", F.lit("servicenow").alias("source"), "severity",
        F.lit("primary").alias("flow"), F.lit("stored").alias("title"))
    none = F.lit(None).cast("string")
    legacy = i.select("external_id", none.alias("source"),
                      F.when(F.col("flow") == "primary", F.col("severity")).alias("severity"),
                      none.alias("flow"), none.alias("title"))
    return readers.import_if_absent(target, legacy, ["severity"]).drop("flow")


@query(f"""WITH {S.REVENTS} SELECT run_id, event_id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY run_id
  ORDER BY ts DESC, event_id DESC) AS INT) AS rank FROM rev) WHERE rank <= 50""")
def stream_retention(spark, sf):
    return sinks.retain_per_run(D.run_events(spark, sf), 50).select("run_id", "event_id", "rank")


@query(f"""WITH {S.REVENTS} SELECT run_id, event_id FROM rev ORDER BY ts DESC, event_id DESC LIMIT 5000""")
def stream_retention_global(spark, sf):
    return sinks.retain_global(D.run_events(spark, sf)).select("run_id", "event_id")


@query(f"""WITH {S.REVENTS} SELECT run_id, event_id FROM rev WHERE run_id IN (SELECT run_id FROM rev GROUP BY run_id
  HAVING max(ts) >= TIMESTAMP '2024-01-30 12:00:00' - INTERVAL 1 HOUR)""")
def expire_idle_runs(spark, sf):
    return sinks.expire_runs(D.run_events(spark, sf), D.ts("2024-01-30 12:00:00")).select("run_id", "event_id")


@query(f"WITH {S.PROBLEMS} SELECT event_id, kind, status FROM prob WHERE upper(status) <> 'RESOLVED'")
def open_events(spark, sf):
    return routing.open_only(D.problem_events(spark, sf)).select("event_id", "kind", "status")


@query(f"WITH {S.PROBLEMS} SELECT event_id, {S.EVENT_SEV} AS severity FROM prob")
def severity_from_event(spark, sf):
    return D.problem_events(spark, sf).select(
        "event_id", rules.severity_of_event(F.col("kind")).alias("severity"))


@query("SELECT o_orderkey, 'P' || left(o_orderpriority, 1) AS severity FROM orders")
def severity_from_priority(spark, sf):
    return D.table(spark, sf, "orders").select(
        "o_orderkey", rules.severity_of_priority(F.substring("o_orderpriority", 1, 1)).alias("severity"))


@query(f"WITH {S.INC} SELECT severity, flow, count(*) AS n FROM inc GROUP BY ALL")
def assign_flow(spark, sf):
    return D.incident_core(spark, sf).groupBy("severity", "flow").agg(F.count("*").alias("n"))


def payloads(spark, sf):
    """Alerts and tickets as JSON texts, as the two webhooks receive them."""
    p = D.problem_events(spark, sf)
    tag = F.when(F.col("service").isNotNull(), F.concat(F.lit("app:"), "service"))
    a = p.select("event_id", "ts", F.to_json(F.struct(
        F.col("problem_id").alias("problemId"), F.concat(F.lit("Alert "), "event_id").alias("displayName"),
        F.col("kind").alias("severity"), "status", F.lit("PROBLEM").alias("eventType"),
        F.array_compact(F.array(F.lit("env:prod"), tag)).alias("tags"),
        F.array(F.struct(F.col("host").alias("name"))).alias("impactedEntities"))).alias("value"))
    i = D.incidents(spark, sf)
    b = i.select(F.to_json(F.struct(
        F.col("external_id").alias("number"), "priority",
        F.concat(F.lit("Ticket "), "external_id").alias("short_description"),
        F.col("service").alias("cmdb_ci"))).alias("value"))
    return a, b


@query(f"""WITH {S.PROBLEMS}, {S.INC}, both_ AS (
  SELECT 'dynatrace' AS source, problem_id AS external_id, {S.EVENT_SEV} AS severity, 'Alert ' || event_id AS title,
    host, service, 'dt:' || problem_id AS dedup_key FROM prob WHERE upper(status) <> 'RESOLVED'
  UNION ALL SELECT 'servicenow', external_id, severity, 'Ticket ' || external_id, service, service, 'snow:' || external_id FROM inc)
  SELECT source, external_id, severity, CASE WHEN severity IN ('P1','P2','P3') THEN 'primary' ELSE 'secondary' END AS flow,
    title, host, service, dedup_key FROM both_""")
def unified_events(spark, sf):
    a, b = payloads(spark, sf)
    pa, _ = routing.parse_problem_events(a)
    pb, _ = routing.parse_ticket_events(b)
    return routing.unify(routing.route_problem_events(pa), routing.route_ticket_events(pb)
                         ).select(*routing.EVENT_COLUMNS)


@query("""SELECT 'bad' AS outcome, count(*) AS n FROM documents UNION ALL
  SELECT 'ok', count(*) FROM (SELECT 1 FROM events UNION ALL SELECT 1 FROM orders)""")
def parse_events(spark, sf):
    """Valid payloads of both sources, and the documents as unreadable ones."""
    a, b = payloads(spark, sf)
    noise = D.table(spark, sf, "documents").select(F.col("text").alias("value"))
    ga, ra = routing.parse_problem_events(a.select("value").unionByName(noise))
    gb, _ = routing.parse_ticket_events(b)
    ok = F.lit("ok").alias("outcome")
    return (ga.select(ok).unionByName(gb.select(ok)).unionByName(ra.select(F.lit("bad").alias("outcome")))
            .groupBy("outcome").agg(F.count("*").alias("n")))


@query(f"""WITH RECURSIVE {S.PROBLEMS}, e AS (SELECT user_id, epoch_us(ts) AS t, min(event_id) AS event_id,
    row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(ts)) AS rn FROM prob GROUP BY user_id, epoch_us(ts)),
  f AS (SELECT user_id, rn, event_id, t AS last, true AS ok FROM e WHERE rn = 1
    UNION ALL SELECT e.user_id, e.rn, e.event_id, CASE WHEN e.t - f.last >= 43200000000 THEN e.t ELSE f.last END,
      e.t - f.last >= 43200000000 FROM f JOIN e ON e.user_id = f.user_id AND e.rn = f.rn + 1)
  SELECT 'dt:PRB-' || user_id AS dedup_key, event_id FROM f WHERE ok""")
def dedup_events(spark, sf):
    """Twelve-hour TTL, so that the sparse test events do collide."""
    e = D.problem_events(spark, sf).withColumn("dedup_key", F.concat(F.lit("dt:"), "problem_id"))
    return routing.dedup_ttl(e, "dedup_key", "ts", "event_id", ttl_seconds=43200).select(
        "dedup_key", "event_id")


@query(f"""WITH {S.RUNS}, {S.STEPS}, stage(flow, agent_num) AS (VALUES ('primary',1),('primary',2),('primary',3),
  ('primary',4),('primary',5),('primary',6),('primary',7),('secondary',1),('secondary',2),('secondary',3),
  ('secondary',6),('secondary',7))
  SELECT run_id, agent_num FROM runs JOIN stage USING (flow)
  WHERE NOT EXISTS (SELECT 1 FROM steps s WHERE s.run_id = runs.run_id AND s.agent_num = stage.agent_num)""")
def missing_stages(spark, sf):
    steps = D.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("agent_num"))
    return routing.missing_stages(D.runs(spark, sf).select("run_id", "flow"), steps).select(
        "run_id", "agent_num")


@query(f"WITH {S.INC} SELECT external_id, right(severity, 1) AS impact, right(severity, 1) AS urgency FROM inc")
def ticket_fields(spark, sf):
    return routing.ticket_fields(D.incident_core(spark, sf)).select("external_id", "impact", "urgency")


@query(f"""WITH {S.INC} SELECT external_id, {S.fmt('''CASE severity WHEN 'P1' THEN opened_at + INTERVAL 15 MINUTE
  WHEN 'P2' THEN opened_at + INTERVAL 60 MINUTE WHEN 'P3' THEN opened_at + INTERVAL 240 MINUTE END''')} AS deadline FROM inc""")
def sla_deadline(spark, sf):
    i = D.incident_core(spark, sf)
    return i.select("external_id", stamp(rules.sla_deadline(F.col("opened_at"), F.col("severity"))).alias("deadline"))


@query(f"""WITH {S.INC} SELECT external_id, (flow = 'secondary' OR severity IN ('P4','P5')) AS skipped,
  CASE WHEN severity IN ('P1','P2') THEN 'high' ELSE 'low' END AS urgency FROM inc""")
def page_eligibility(spark, sf):
    return routing.page_eligibility(D.incident_core(spark, sf)).select("external_id", "skipped", "urgency")


@query(f"""WITH {S.INC} SELECT external_id, CASE severity WHEN 'P1' THEN 'Critical-Response-Team' WHEN 'P2'
  THEN 'Platform-Engineering' WHEN 'P3' THEN 'Application-Support' END AS group_name,
  CASE WHEN severity IN ('P1','P2','P3') THEN right(severity,1) END AS impact FROM inc""")
def assignment_lookup(spark, sf):
    return routing.assignment_lookup(D.incident_core(spark, sf), routing.config_table(spark)).select(
        "external_id", "group_name", "impact")


@query(f"""WITH {S.INC}, {S.PROBLEMS}, ev AS (SELECT external_id, flow FROM inc
    UNION ALL SELECT problem_id, CASE WHEN {S.EVENT_SEV} IN ('P1','P2','P3') THEN 'primary' ELSE 'secondary' END FROM prob),
  t AS (SELECT printf('INC%07d', o_orderkey) AS number, 'T' || o_orderkey AS ticket_id, o_orderpriority AS owner_group
    FROM orders WHERE o_orderstatus = 'F')
  SELECT external_id, flow, CASE WHEN flow = 'primary' THEN 'created' WHEN number IS NOT NULL THEN 'bound' ELSE 'skipped' END AS action,
    CASE WHEN flow <> 'primary' THEN ticket_id END AS ticket_id
  FROM ev LEFT JOIN t ON external_id = number AND flow <> 'primary'""")
def bind_tickets(spark, sf):
    p = D.problem_events(spark, sf)
    a = p.select(F.col("problem_id").alias("external_id"),
                 rules.flow_of(rules.severity_of_event(F.col("kind"))).alias("flow"))
    ev = D.incident_core(spark, sf).select("external_id", "flow").unionByName(a)
    t = D.table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(
        D.ticket_no(F.col("o_orderkey")).alias("number"),
        F.concat(F.lit("T"), "o_orderkey").alias("ticket_id"), F.col("o_orderpriority").alias("owner_group"))
    return routing.bind_tickets(ev, t).select("external_id", "flow", "action", "ticket_id")


@query(f"""WITH {S.INC}, oc AS (SELECT s_nationkey, s_name, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS rn FROM supplier)
  SELECT external_id, s_name AS on_call FROM inc LEFT JOIN nation ON n_name = team
  LEFT JOIN oc ON s_nationkey = n_nationkey AND rn = 1""")
def oncall_lookup(spark, sf):
    """The escalation policy of an incident is the nation of its team; suppliers are on call."""
    n = D.table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("policy_id"))
    oc = (D.table(spark, sf, "supplier").join(n, F.col("s_nationkey") == F.col("n_nationkey"))
          .select("policy_id", F.col("s_suppkey").alias("position"), F.col("s_name").alias("name")))
    inc = D.incidents(spark, sf).withColumnRenamed("team", "policy_id")
    return routing.oncall_lookup(inc, oc).select("external_id", F.col("name").alias("on_call"))
