"""Rule checks over declared tables, and gap reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from triagelake import schemas


def constraint_audit(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rule, violations): value lists, ranges, unique and foreign keys."""
    parts = []
    for name, df in tables.items():
        checks = {}
        for (t, col), allowed in schemas.ALLOWED.items():
            if t == name and col in df.columns:
                checks[f"allowed:{col}"] = F.count_if(F.col(col).isNotNull() & ~F.col(col).isin(allowed))
        for (t, col), (lo, hi) in schemas.RANGES.items():
            if t == name and col in df.columns:
                checks[f"range:{col}"] = F.count_if(F.col(col).isNotNull() & ~F.col(col).between(lo, hi))
        if checks:
            # All value checks of a table share one scan.
            agg = df.agg(*[c.alias(k) for k, c in checks.items()])
            rows = F.array(*[F.struct(F.lit(k).alias("rule"), F.col(f"`{k}`").alias("violations"))
                             for k in checks])
            parts.append(agg.select(F.lit(name).alias("table_name"), F.explode(rows).alias("r"))
                         .select("table_name", "r.*"))
        for cols in schemas.UNIQUE.get(name, []):
            if all(c in df.columns for c in cols):
                dup = df.groupBy(*cols).agg(F.count("*").alias("n")).where(F.col("n") > 1)
                parts.append(dup.agg(F.count("*").alias("violations")).select(
                    F.lit(name).alias("table_name"), F.lit("unique:" + ",".join(cols)).alias("rule"),
                    "violations"))
    for (t, col), (pt, pcol) in schemas.FOREIGN.items():
        if t in tables and pt in tables:
            lost = tables[t].where(F.col(col).isNotNull()).join(
                tables[pt].select(F.col(pcol).alias(col)), col, "left_anti")
            parts.append(lost.agg(F.count("*").alias("violations")).select(
                F.lit(t).alias("table_name"), F.lit(f"foreign:{col}").alias("rule"), "violations"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cmdb_gap(services: DataFrame, items: DataFrame, name: str = "name") -> DataFrame:
    """(name, found) for every monitored service; one join, no lookups."""
    known = items.select(name).distinct().withColumn("found", F.lit(True))
    return services.select(name).distinct().join(known, name, "left").withColumn(
        "found", F.coalesce("found", F.lit(False)))


def gap_counts(gap: DataFrame) -> DataFrame:
    return gap.agg(F.count_if("found").alias("found"), F.count_if(~F.col("found")).alias("missing"))
