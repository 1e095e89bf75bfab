"""Closed incidents to clean, scrubbed and scored rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from triagelake.functions import text
from triagelake.functions.evaluate import once
from triagelake.functions.text import nullif_empty

SCRUBBED_FIELDS = ["short_description", "description", "close_notes"]


def _clean(name: str) -> Column:
    return text.collapse_whitespace(text.strip_markup(F.col(name)))


def not_excluded(code: Column) -> Column:
    return ~F.coalesce(text.strip_edges(code), F.lit("")).isin(text.EXCLUDED_CLOSE_CODES)


def _normalized(raw: DataFrame) -> DataFrame:
    """All rows, cleaned, with a flag `_valid` for those normalisation keeps."""
    closed = F.try_to_timestamp(F.col("closed_at"), F.lit("yyyy-M-d H:m:s"))
    extra = [c for c in ("attributed", "caller_id") if c in raw.columns]
    cleaned = once(raw, {
        **{c: _clean(c) for c in SCRUBBED_FIELDS},
        "close_code": F.coalesce(text.strip_edges(F.col("close_code")), F.lit("")),
        "assignment_group": F.coalesce(text.strip_edges(F.col("assignment_group")), F.lit("")),
        "category": nullif_empty(F.col("category")), "subcategory": nullif_empty(F.col("subcategory")),
        "closed_at": closed}, ["number", *extra])
    return cleaned.withColumn("_valid", not_excluded(F.col("close_code"))
                              & (F.col("close_notes") != "") & F.col("closed_at").isNotNull())


def normalize_incidents(raw: DataFrame) -> DataFrame:
    """Drop excluded codes, empty resolutions and unreadable times; clean the text fields."""
    return (_normalized(raw.where(not_excluded(F.col("close_code")))).where("_valid").drop("_valid")
            .withColumn("closed_at_iso", F.date_format("closed_at", "yyyy-MM-dd'T'HH:mm:ss")))


def scrub_incidents(clean: DataFrame) -> DataFrame:
    """Scrubbed text fields and the number of redactions over all of them."""
    done = once(clean, {f"_{c}": text.scrub(F.col(c)) for c in SCRUBBED_FIELDS})
    n = F.lit(0)
    for c in SCRUBBED_FIELDS:
        n = n + text.scrub_count(F.col(c), F.col(f"_{c}"))
    return (done.withColumn("redactions", n).withColumns({c: F.col(f"_{c}") for c in SCRUBBED_FIELDS})
                .drop(*[f"_{c}" for c in SCRUBBED_FIELDS]))


def score_incidents(clean: DataFrame) -> DataFrame:
    return once(clean, {"quality": text.quality_score(
        F.col("close_notes"), F.col("close_code"),
        F.col("attributed") if "attributed" in clean.columns else None,
        F.col("caller_id") if "caller_id" in clean.columns else None)})


def prepare_incidents(raw: DataFrame) -> DataFrame:
    """Normalised, scrubbed and scored incidents, before the quality floor."""
    return score_incidents(scrub_incidents(normalize_incidents(raw)))


def quality_gate(scored: DataFrame, floor: float = 0.40) -> DataFrame:
    return scored.where(F.col("quality") >= floor)


def gate_counts(raw: DataFrame, floor: float = 0.40) -> DataFrame:
    """Extracted, kept and filtered counts from one pass over the extract."""
    scored = score_incidents(scrub_incidents(_normalized(raw)))
    return scored.agg(
        F.count("*").alias("extracted"),
        F.count_if(F.col("_valid") & (F.col("quality") >= floor)).alias("kept")
    ).withColumn("filtered", F.col("extracted") - F.col("kept"))


def field_coverage(df: DataFrame, required: list[str]) -> DataFrame:
    """Present flag and non-null count per required column, from one aggregate."""
    present = [c for c in required if c in df.columns]
    agg = df.agg(*[F.count(c).alias(c) for c in present], F.count("*").alias("_rows"))
    rows = F.array(*[F.struct(F.lit(c).alias("field"), F.lit(c in present).alias("present"),
                              (F.col(c) if c in present else F.lit(0).cast("bigint"))
                              .alias("non_null")) for c in required])
    return agg.select(F.explode(rows).alias("r")).select("r.*")


def missing_fields(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]
