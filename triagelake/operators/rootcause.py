"""Root-cause context, result parsing and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake import schemas
from triagelake.functions import rules
from triagelake.functions.evaluate import once

# ---- Fixed values ---------------------------------------------------------------
NO_MATCHES = "No KB matches."
FALLBACK_CAUSE, FALLBACK_CONFIDENCE, DEFAULT_CONFIDENCE = (
    "Unable to determine root cause automatically.", 0.3, 0.5)
# -----------------------------------------------------------------------------


def kb_lines(hits: DataFrame, key: str, k: int = 3) -> DataFrame:
    """(key, kb_text): the top k hits as lines."""
    line = F.concat(F.lit("- "), "title", F.lit(" ("), F.format_string("%.2f", F.col("score")),
                    F.lit("): "), "excerpt")
    top = hits.where(F.col("rank") <= k)
    return top.groupBy(key).agg(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))), lambda x: x["line"]), "\n")
        .alias("kb_text"))


def context(events: DataFrame, logs: DataFrame, kb: DataFrame, tickets: DataFrame, key: str) -> DataFrame:
    """Event, log figures, knowledge lines and ticket of each incident as one text."""
    j = events.join(logs, key, "left").join(kb, key, "left").join(tickets, key, "left")
    na = lambda c, d: F.coalesce(F.col(c), F.lit(d))                                # noqa: E731
    body = F.concat_ws(
        "\n",
        F.concat(F.lit("Title: "), na("title", "Unknown incident")),
        F.concat(F.lit("Severity: "), na("severity", "P3")),
        F.concat(F.lit("Source: "), na("source", "unknown")),
        F.format_string("Errors: %d, Warns: %d", F.coalesce("errors", F.lit(0)),
                        F.coalesce("warnings", F.lit(0))),
        F.concat(F.lit("Classification: "), na("classification", "unknown")),
        F.concat(F.lit("Summary: "), na("summary", "No log data available")),
        na("kb_text", NO_MATCHES),
        F.concat(F.lit("INC: "), na("ticket_id", "N/A")))
    return j.select(key, body.alias("context"))


def parse_results(raw: DataFrame, value: str = "value") -> DataFrame:
    """Parsed result columns; unreadable text becomes the fallback record.

    A step that is not an object is wrapped as the action of its position."""
    r = once(raw, {"_r": F.from_json(value, schemas.ROOT_CAUSE),
                   "_bad": F.json_object_keys(value).isNull()})
    step = lambda s, i: F.when(F.json_object_keys(s).isNotNull(), F.from_json(s, schemas.STEP)).otherwise(
        F.struct((i + 1).alias("step_num"), s.alias("action"),
                 *[F.lit(None).cast("string").alias(c) for c in ("owner", "tool", "command", "rationale")]))
    steps = F.transform(F.coalesce("_r.resolution_steps", F.array().cast("array<string>")), step)
    return r.withColumns({
        "root_cause": F.when(F.col("_bad"), FALLBACK_CAUSE).otherwise(F.coalesce("_r.root_cause", F.lit(""))),
        "root_cause_category": F.when(F.col("_bad"), "unknown").otherwise(F.col("_r.root_cause_category")),
        "confidence": F.when(F.col("_bad"), FALLBACK_CONFIDENCE).otherwise(
            F.coalesce(F.col("_r.confidence").try_cast("double"), F.lit(DEFAULT_CONFIDENCE))),
        "rollback_required": ~F.col("_bad") & F.coalesce("_r.rollback_required", F.lit(False)),
        "rollback_target": F.col("_r.rollback_target"),
        "steps": F.when(~F.col("_bad"), steps).otherwise(F.array().cast(
            "array<struct<step_num:int,action:string,owner:string,tool:string,command:string,rationale:string>>")),
    }).drop("_r", "_bad")


def result_problem(confidence: Column, severity: Column, flow: Column) -> Column:
    """First broken rule, or null."""
    return (F.when(~F.coalesce(confidence.between(0.0, 1.0), F.lit(False)), "confidence")
             .when(~F.coalesce(severity.isin(rules.SEVERITIES), F.lit(False)), "severity")
             .when(~F.coalesce(flow.isin(*rules.FLOW_STAGES), F.lit(False)), "flow"))


def triage_note(errors, warnings, minutes, classification, summary) -> Column:
    return F.concat(
        F.lit("[Auto-Triage]\n"),
        F.format_string("Logs: %d errors / %d warns in last %dmin.\n", errors, warnings, minutes),
        F.lit("Classification: "), classification, F.lit("\nSummary: "), summary)


def final_note(cause, category, confidence, rollback, target, actions) -> Column:
    first = F.array_join(F.transform(F.slice(actions, 1, 5), lambda a, i: F.concat(
        (i + 1).cast("string"), F.lit(". "), a)), "\n")
    return F.concat(
        F.lit("[Final RCA]\nRoot cause: "), cause, F.lit("\nCategory: "), category,
        F.lit("\nConfidence: "), F.bround(confidence * 100).cast("int").cast("string"),
        F.lit("%\nRollback required: "),
        F.when(rollback, F.concat(F.lit("YES — target: "), F.coalesce(target, F.lit("latest"))))
         .otherwise("No"), F.lit("\n\nResolution steps:\n"), first)
