"""Numeric scores for articles, dedup and search."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- Fixed values: weights and cut points -----------------------------------
UPDATE_AT, REVIEW_AT = 0.92, 0.80
W_COHESION, W_COUNT, W_SELF, W_FEEDBACK = 0.30, 0.20, 0.20, 0.30
W_DENSE, W_SPARSE, W_RECENT = 0.6, 0.3, 0.1
NEUTRAL_FEEDBACK = 0.5
MIN_COHESION, MIN_CLUSTER = 0.65, 2
HIDE_BELOW = 0.40
TIER_BONUS = 0.8
# -----------------------------------------------------------------------------


def confidence(cohesion: Column, members: Column, self_rating: Column, feedback: Column) -> Column:
    volume = (F.when(members > 0,
                     F.least(F.lit(1.0), F.log10(members + 1.0) / 1.5)).otherwise(0.0))
    blend = (W_COHESION * cohesion + W_COUNT * volume + W_SELF * self_rating
             + W_FEEDBACK * F.coalesce(feedback, F.lit(NEUTRAL_FEEDBACK)))
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), blend))


def dedup_decision(similarity: Column, has_article: Column | None = None) -> Column:
    d = (F.when(similarity >= UPDATE_AT, "update")
          .when(similarity >= REVIEW_AT, "review").otherwise("create"))
    return d if has_article is None else F.when(~has_article, "skip").otherwise(d)


def hybrid(dense: Column, sparse: Column, recency: Column) -> Column:
    return W_DENSE * dense + W_SPARSE * sparse + W_RECENT * recency
