"""Chat history: budget trim, titles, citation ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake.functions import rules, text
from triagelake.operators.keyed import running_sum


def trim_history(messages: DataFrame, budget: int = 8000, slice_turns: int = 1000) -> DataFrame:
    """The newest messages of each conversation whose running cost stays in the budget.

    Costs are never negative, so the running sum from the end grows and the
    filter equals stopping at the first message that does not fit.
    """
    costed = messages.withColumn("tokens", text.token_estimate(F.col("text"))).withColumn(
        "_slice", F.floor(F.col("turn") / slice_turns))
    s = running_sum(costed, ["conv_id"], "_slice", [F.col("turn").desc()], "tokens", "used",
                    descending=True)
    return s.where(F.col("used") <= budget).drop("_slice")


def session_titles(messages: DataFrame, width: int = 48) -> DataFrame:
    """First user message of each conversation, shortened; newest conversation first."""
    first = messages.groupBy("conv_id").agg(
        F.min_by("text", F.when(F.col("role") == "user", F.col("turn"))).alias("_t"))
    title = (F.when(F.col("_t").isNull(), "New conversation")
              .when(F.length("_t") > width, F.concat(F.substring("_t", 1, width), F.lit("…")))
              .otherwise(F.col("_t")))
    return first.select("conv_id", title.alias("title"))


def rank_citations(citations: DataFrame, group: str, title: str, score: str, position: str) -> DataFrame:
    """Best citation per title, with its label; ties keep the earlier position."""
    payload = [c for c in citations.columns if c not in (group, title)]
    best = citations.groupBy(group, title).agg(
        F.max_by(F.struct(*payload), F.struct(F.col(score), -F.col(position))).alias("_c"))
    return best.select(group, title, *[F.col(f"_c.{c}").alias(c) for c in payload],
                       rules.match_label(F.col(f"_c.{score}")).alias("label"))
