"""Event normalisation, routing, dedup and ticket fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake import schemas
from triagelake.functions import rules
from triagelake.functions.evaluate import once
from triagelake.operators import ttl
from triagelake.operators.keyed import top_per_key

EVENT_COLUMNS = ["source", "external_id", "severity", "flow", "title", "host", "service", "dedup_key"]


def parse_payloads(raw: DataFrame, schema, required: list[str], value: str = "value",
                   ) -> tuple[DataFrame, DataFrame]:
    """JSON payloads to (valid, rejects); unknown fields stay in the raw text."""
    parsed = once(raw, {"p": F.from_json(F.col(value), schema)})
    ok = F.col("p").isNotNull()
    for name in required:
        ok = ok & F.col(f"p.{name}").isNotNull()
    flagged = parsed.withColumn("_ok", F.coalesce(ok, F.lit(False)))
    good = flagged.where("_ok").drop("_ok")
    bad = flagged.where(~F.col("_ok")).select(value)
    return good, bad


def parse_problem_events(raw: DataFrame, value: str = "value"):
    return parse_payloads(raw, schemas.PROBLEM_EVENT, schemas.REQUIRED_PROBLEM, value)


def parse_ticket_events(raw: DataFrame, value: str = "value"):
    return parse_payloads(raw, schemas.TICKET_EVENT, schemas.REQUIRED_TICKET, value)


def open_only(events: DataFrame, status: str = "status") -> DataFrame:
    return events.where(F.upper(status) != "RESOLVED")


def route_problem_events(parsed: DataFrame, value: str = "value", keep: list[str] = ()) -> DataFrame:
    """Source A payload structs `p` to event rows; resolved ones are dropped."""
    p = open_only(parsed, "p.status")
    sev = rules.severity_of_event(F.col("p.severity"))
    return p.select(
        F.lit("dynatrace").alias("source"), F.col("p.problemId").alias("external_id"),
        sev.alias("severity"), rules.flow_of(sev).alias("flow"),
        F.col("p.displayName").alias("title"),
        F.get("p.impactedEntities", F.lit(0))["name"].alias("host"),
        rules.first_tag_value(F.col("p.tags"), "app:").alias("service"),
        F.concat(F.lit("dt:"), "p.problemId").alias("dedup_key"),
        F.col(value).alias("raw_payload"), *keep)


def route_ticket_events(parsed: DataFrame, value: str = "value", keep: list[str] = ()) -> DataFrame:
    sev = rules.severity_of_priority(F.col("p.priority"))
    return parsed.select(
        F.lit("servicenow").alias("source"), F.col("p.number").alias("external_id"),
        sev.alias("severity"), rules.flow_of(sev).alias("flow"),
        F.col("p.short_description").alias("title"),
        F.col("p.cmdb_ci").alias("host"), F.col("p.cmdb_ci").alias("service"),
        F.concat(F.lit("snow:"), "p.number").alias("dedup_key"),
        F.col(value).alias("raw_payload"), *keep)


def unify(problems: DataFrame, tickets: DataFrame) -> DataFrame:
    return problems.unionByName(tickets)


# ---- dedup with a time to live -----------------------------------------------

def dedup_ttl(events: DataFrame, key: str, ts: str, id_col: str, ttl_seconds: int = 300) -> DataFrame:
    """Accepted events: the first per key, then the first at least TTL after the last accepted one.

    Equal instants of a key collapse to the smallest id before anything is sorted.
    """
    return ttl.accepted(events, key, ts, id_col, ttl_seconds)


# ---- tickets, paging, on-call --------------------------------------------------

def ticket_fields(incidents: DataFrame) -> DataFrame:
    code = rules.ticket_code(F.col("severity"))
    return incidents.withColumn("impact", code).withColumn("urgency", code)


def page_eligibility(incidents: DataFrame) -> DataFrame:
    return incidents.select(
        "*", rules.page_skipped(F.col("flow"), F.col("severity")).alias("skipped"),
        rules.page_urgency(F.col("severity")).alias("urgency"))


def assignment_lookup(incidents: DataFrame, config: DataFrame) -> DataFrame:
    """Assignment group and impact from the key/value configuration (a fixed table of ten rows)."""
    low = F.lower("severity")
    group = config.select(F.col("config_key").alias("_gk"), F.col("config_value").alias("group_name"))
    impact = config.select(F.col("config_key").alias("_ik"), F.col("config_value").alias("impact"))
    return (incidents
            .join(F.broadcast(group), F.concat(F.lit("assignment_group_"), low) == F.col("_gk"), "left")
            .join(F.broadcast(impact), F.concat(F.lit("impact_"), low) == F.col("_ik"), "left")
            .drop("_gk", "_ik"))


def config_table(spark) -> DataFrame:
    return spark.createDataFrame(list(rules.ESCALATION_CONFIG.items()),
                                 "config_key string, config_value string")


def bind_tickets(events: DataFrame, tickets: DataFrame) -> DataFrame:
    """Primary events create a ticket; others bind to an existing INC number or are skipped."""
    t = tickets.select(F.col("number").alias("_n"), "ticket_id", "owner_group")
    j = events.join(t, (F.col("external_id") == F.col("_n"))
                    & F.startswith(F.col("external_id"), F.lit("INC"))
                    & (F.col("flow") != "primary"), "left")
    action = (F.when(F.col("flow") == "primary", "created")
               .when(F.col("_n").isNotNull(), "bound").otherwise("skipped"))
    return j.withColumn("action", action).drop("_n")


def missing_stages(runs: DataFrame, steps: DataFrame) -> DataFrame:
    """Stages the flow of a run calls for and that have no step row."""
    stages = rules.lookup(F.col("flow"), {f: ",".join(map(str, agents))
                                          for f, agents in rules.FLOW_STAGES.items()})
    need = runs.select("run_id", "flow",
                       F.explode(F.split(stages, ",").cast("array<int>")).alias("agent_num"))
    return need.join(steps.select("run_id", "agent_num"), ["run_id", "agent_num"], "left_anti")


def oncall_lookup(incidents: DataFrame, oncalls: DataFrame) -> DataFrame:
    """First on-call entry of each policy, null when the policy has none."""
    first = top_per_key(oncalls, ["policy_id"], [F.col("position"), F.col("name")], 1).drop("rank", "position")
    return incidents.join(first, "policy_id", "left")
