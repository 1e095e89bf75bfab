"""Scans: closed-incident extract, lookback poll, payload files, bulk import, seeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.operators.keyed import insert_if_absent

# Closed state, poll lookback and priorities.
CLOSED_STATE = "7"
POLL_MINUTES, POLL_PRIORITIES = 5, ["1", "2", "3", "4", "5"]


def closed_incident_scan(incidents: DataFrame, start: str, end: str, state: str = "state",
                         closed_at: str = "closed_at", columns: list[str] | None = None,
                         closed: str = CLOSED_STATE) -> DataFrame:
    """Closed rows from the start day to the end day inclusive.

    The bounds take the type of the time column, so both filters reach the scan."""
    c, kind = F.col(closed_at), incidents.schema[closed_at].dataType
    day_after = F.date_add(F.lit(end).cast("date"), 1)
    out = incidents.where((F.col(state) == closed) & (c >= F.lit(start).cast(kind))
                          & (c < day_after.cast(kind)))
    return out.select(*columns) if columns else out


def poll_recent(records: DataFrame, as_of: Column, minutes: int = POLL_MINUTES,
                priorities: list[str] | None = None, seen: DataFrame | None = None,
                cap: int | None = None) -> DataFrame:
    """Ticket rows of the lookback window whose number is not in `seen`.

    Nested value/display fields flatten with their defaults; a number counts once.
    A `cap` is the page size of one poll; what it leaves out is not seen, so the
    next poll gets it."""
    p = F.coalesce("priority.value", F.lit("4"))
    w = records.where((F.col("created_at") >= as_of - F.make_dt_interval(mins=F.lit(minutes)))
                      & (F.col("created_at") <= as_of)
                      & p.isin(priorities or POLL_PRIORITIES))
    flat = w.select(
        "number", p.alias("priority"), F.coalesce("short_description", F.lit("")).alias("short_description"),
        F.coalesce("caller_id.display_value", F.lit("")).alias("caller_id"),
        F.coalesce("cmdb_ci.display_value", F.lit("")).alias("cmdb_ci"),
        F.coalesce("state.value", F.lit("1")).alias("state"), "created_at",
        *([F.coalesce("category", F.lit("")).alias("category")] if "category" in records.columns else []))
    if seen is not None:
        flat = flat.join(seen.select("number"), "number", "left_anti")
    payload = [c for c in flat.columns if c != "number"]
    one = flat.groupBy("number").agg(F.min_by(F.struct(*payload), "created_at").alias("r"))
    out = one.select("number", "r.*")
    return out if cap is None else out.orderBy("created_at", "number").limit(cap)


IMPORT_DEFAULTS = {"source": "dynatrace", "severity": "P3", "flow": "primary", "title": ""}


def import_if_absent(target: DataFrame, legacy: DataFrame, order: list[str]) -> DataFrame:
    """Legacy incidents with column defaults, added where the external id is new."""
    filled = legacy.withColumns({c: F.coalesce(c, F.lit(d)) for c, d in IMPORT_DEFAULTS.items()})
    return insert_if_absent(target, filled, ["external_id"], order)
