"""Log search, per-incident log totals and error classification."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions import rules
from triagelake.operators.intervals import counts_in_window, newest_in_window, top_in_window


def keyword_match(text: Column, keywords: list[str]) -> Column:
    """Any keyword as a phrase on word bounds, case-insensitive."""
    any_of = "|".join(r"\Q" + k + r"\E" for k in keywords)
    return F.regexp_like(text, F.lit(rf"(?i)\b(?:{any_of})\b"))


def level_top(logs: DataFrame, keywords: list[str], start: Column | None = None,
              end: Column | None = None, entity=None, source_part: str | None = None,
              limit: int = 20) -> DataFrame:
    """Keyword search, counts per level, largest first."""
    hits = logs.where(keyword_match(F.concat_ws(" ", "level", "content"), keywords))
    if start is not None:
        hits = hits.where((F.col("ts") >= start) & (F.col("ts") <= end))
    if entity is not None:
        hits = hits.where(F.col("entity") == entity)
    if source_part is not None:
        hits = hits.where(F.contains(F.col("source"), F.lit(source_part)))
    return (hits.groupBy("level").agg(F.count("*").alias("n"))
                .orderBy(F.col("n").desc(), "level").limit(limit))


def by_entity(logs: DataFrame, columns: list[str]) -> DataFrame:
    """One row per distinct entity key of a log line (host, service, process group)."""
    keys = F.array_distinct(F.array_compact(F.array(*columns)))
    return logs.withColumn("entity", F.explode(keys)).drop(*columns)


def log_window_join(incidents: DataFrame, logs: DataFrame, minutes: int = 15, limit: int = 50,
                    keywords: list[str] | None = None) -> DataFrame:
    """Newest error/warn/severe lines of the incident's entity within +/- minutes."""
    wanted = logs.where(F.col("level").isin(rules.LOG_LEVELS))
    if keywords:
        wanted = wanted.where(keyword_match(F.col("content"), keywords))
    span = F.make_dt_interval(mins=F.lit(minutes))
    windows = incidents.select("external_id", "entity", (F.col("opened_at") - span).alias("lo"),
                               (F.col("opened_at") + span).alias("hi"))
    return newest_in_window(wanted, windows, "entity", "external_id", "event_id", limit)


def _look_back(incidents: DataFrame) -> DataFrame:
    """The look-back window of each incident's severity."""
    span = F.make_dt_interval(mins=rules.log_window_minutes(F.col("severity")))
    return incidents.select("external_id", "entity", (F.col("opened_at") - span).alias("lo"),
                            F.col("opened_at").alias("hi"))


def incident_log_counts(incidents: DataFrame, logs: DataFrame) -> DataFrame:
    """(external_id, level, n) over the look-back window; levels are a fixed few, messages are not read."""
    return counts_in_window(logs, _look_back(incidents), "entity", ["level"], "external_id",
                            bucket_seconds=3600)


def log_totals(counts: DataFrame) -> DataFrame:
    """Scanned lines, errors and warnings per incident."""
    lv = F.upper("level")
    return counts.groupBy("external_id").agg(
        F.sum("n").alias("scanned"),
        F.sum(F.when(F.contains(lv, F.lit("ERROR")), F.col("n")).otherwise(0)).alias("errors"),
        F.sum(F.when(F.contains(lv, F.lit("WARN")), F.col("n")).otherwise(0)).alias("warnings"))


def top_messages(incidents: DataFrame, logs: DataFrame, k: int = 5) -> DataFrame:
    """The k most frequent messages of each incident's window, in order."""
    top = top_in_window(logs, _look_back(incidents), "entity", "content", "external_id", k)
    return top.groupBy("external_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "content"))),
                    lambda x: x["content"]).alias("top_errors"))


def analyse_logs(incidents: DataFrame, logs: DataFrame) -> DataFrame:
    """Per incident: totals, top messages, class and summary line; zero rows included."""
    out = (incidents.join(log_totals(incident_log_counts(incidents, logs)), "external_id", "left")
                    .join(top_messages(incidents, logs), "external_id", "left"))
    out = (out.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("scanned", "errors", "warnings")})
              .withColumn("top_errors", F.coalesce("top_errors", F.array().cast("array<string>"))))
    return (out.withColumn("classification", rules.error_class(F.col("top_errors"), F.col("errors")))
               .withColumn("summary", summary_text(F.col("errors"), F.col("warnings"),
                                                   rules.log_window_minutes(F.col("severity")))))


def summary_text(errors: Column, warnings: Column, minutes: Column) -> Column:
    return F.format_string("Found %d errors and %d warnings over last %dmin.", errors, warnings, minutes)
