"""Rule tables as column expressions. Every lookup folds into whole-stage codegen."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: classification and routing tables ------------------------
EVENT_SEVERITY = {
    "AVAILABILITY": "P1",
    "PERFORMANCE": "P2",
    "ERROR": "P3",
    "RESOURCE": "P3",
    "CUSTOM": "P4",
    "INFO": "P5",
}
TICKET_PRIORITY = {"1": "P1", "2": "P2", "3": "P3", "4": "P4", "5": "P5"}
SEVERITIES = ["P1", "P2", "P3", "P4", "P5"]
PRIMARY_SEVERITIES = ["P1", "P2", "P3"]
LOG_WINDOW_MINUTES = {"P1": 15, "P2": 30, "P3": 30, "P4": 60, "P5": 60}
LOG_WINDOW_DEFAULT = 30
SLA_MINUTES = {"P1": 15, "P2": 60, "P3": 240, "P4": 0, "P5": 0}
TICKET_CODE = {"P1": "1", "P2": "2", "P3": "3", "P4": "4", "P5": "5"}
TICKET_CODE_DEFAULT = "3"
ESCALATION_CONFIG = {
    "assignment_group_p1": "Critical-Response-Team",
    "assignment_group_p2": "Platform-Engineering",
    "assignment_group_p3": "Application-Support",
    "category": "Software",
    "impact_p1": "1",
    "impact_p2": "2",
    "impact_p3": "3",
    "state_in_progress": "2",
    "state_resolved": "6",
}
FLOW_STAGES = {
    "primary": [1, 2, 3, 4, 5, 6, 7],
    "secondary": [1, 2, 3, 6, 7],
}
ERROR_CLASSES = [
    ("db_connection", ["connection", "timeout"]),
    ("memory", ["memory", "oom", "heap"]),
    ("deployment", ["deploy", "classnot"]),
]
HIGH_ERROR_RATE = 100
LOG_LEVELS = ["ERROR", "WARN", "SEVERE"]
LOG_KEYWORDS = ["ERROR", "WARN", "CRITICAL", "Exception", "Traceback"]
STRONG_MATCH, LIKELY_MATCH = 0.85, 0.70
# -----------------------------------------------------------------------------


def lookup(key: Column, table: dict, default=None) -> Column:
    """Constant-map lookup with a default; the map is a literal of fixed size."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    hit = F.try_element_at(F.create_map(*pairs), key)
    return hit if default is None else F.coalesce(hit, F.lit(default))


def severity_of_event(kind: Column) -> Column:
    return lookup(F.upper(kind), EVENT_SEVERITY, "P5")


def severity_of_priority(priority: Column) -> Column:
    return lookup(priority.cast("string"), TICKET_PRIORITY, "P5")


def flow_of(severity: Column) -> Column:
    return F.when(severity.isin(PRIMARY_SEVERITIES), "primary").otherwise("secondary")


def log_window_minutes(severity: Column) -> Column:
    return lookup(severity, LOG_WINDOW_MINUTES, LOG_WINDOW_DEFAULT)


def ticket_code(severity: Column) -> Column:
    return lookup(severity, TICKET_CODE, TICKET_CODE_DEFAULT)


def sla_minutes(severity: Column) -> Column:
    return lookup(severity, SLA_MINUTES, 0)


def sla_deadline(start: Column, severity: Column) -> Column:
    """start + allowed minutes; null where the severity carries no deadline."""
    m = sla_minutes(severity)
    return F.when(m > 0, start + F.make_dt_interval(mins=m))


def page_skipped(flow: Column, severity: Column) -> Column:
    return (flow == "secondary") | severity.isin("P4", "P5")


def page_urgency(severity: Column) -> Column:
    return F.when(severity.isin("P1", "P2"), "high").otherwise("low")


def error_class(messages: Column, errors: Column) -> Column:
    """First matching keyword family over the joined messages, else by volume."""
    text = F.lower(F.array_join(messages, " "))
    out = None
    for name, words in ERROR_CLASSES:
        hit = F.lit(False)
        for w in words:
            hit = hit | F.contains(text, F.lit(w))
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.when(errors > HIGH_ERROR_RATE, "high_error_rate").otherwise("unknown")


def match_label(score: Column) -> Column:
    return (F.when(score >= STRONG_MATCH, "Strong match")
             .when(score >= LIKELY_MATCH, "Likely match").otherwise("Weak match"))


def first_tag_value(tags: Column, prefix: str) -> Column:
    """Text after the first colon of the first tag with the prefix, else null."""
    tag = F.get(F.filter(tags, lambda t: F.startswith(t, F.lit(prefix))), F.lit(0))
    return F.substr(tag, F.lit(len(prefix) + 1))


def percent_truncated(confidence: Column) -> Column:
    return (confidence * 100).cast("int")


def round_half_up_js(x: Column) -> Column:
    return F.floor(x + 0.5)
