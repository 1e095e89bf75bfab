"""The given star-schema tables seen as incident data.

Each function reads only the columns it needs; filters added by callers reach
the parquet scan. No broadcast hints: customer and orders grow with the data,
so Spark chooses the join from their sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.functions import rules

AS_OF = "2024-01-31 00:00:00"
EPOCH = "2024-01-01 00:00:00"
PLANT = 0.3


def ts(text: str) -> Column:
    return F.lit(text).cast("timestamp")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table.

    A Parquet file of one row group is one task. A caller with few such files of long
    texts sets spark.triagelake.textPartitions to deal the documents out first.
    """
    df = spark.read.parquet(f"{sf}/{name}.parquet")
    parts = spark.conf.get("spark.triagelake.textPartitions", None) if name == "documents" else None
    return df.repartition(int(parts), "doc_id") if parts else df


def ticket_no(key: Column) -> Column:
    return F.format_string("INC%07d", key)


def _opened(key: Column) -> Column:
    return ts(EPOCH) + F.make_dt_interval(mins=((key * 173) % 43200).cast("int"))


def incidents(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.substring("o_orderpriority", 1, 1).alias("priority"))
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey",
                                            F.col("c_mktsegment").alias("service"))
    n = table(spark, sf, "nation").select("n_nationkey", F.col("n_name").alias("team"))
    sev = rules.severity_of_priority(F.col("priority"))
    return (o.join(c, o.o_custkey == c.c_custkey, "left")
             .join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
             .select(F.col("o_orderkey").alias("incident_key"),
                     ticket_no(F.col("o_orderkey")).alias("external_id"),
                     "priority", sev.alias("severity"), rules.flow_of(sev).alias("flow"),
                     _opened(F.col("o_orderkey")).alias("opened_at"),
                     (F.col("o_custkey") % 150).alias("entity"), "service", "team"))


def incident_core(spark: SparkSession, sf: str) -> DataFrame:
    """Incidents without the customer columns: one scan, no join."""
    o = table(spark, sf, "orders").select(
        "o_orderkey", "o_custkey", F.substring("o_orderpriority", 1, 1).alias("priority"))
    sev = rules.severity_of_priority(F.col("priority"))
    return o.select(F.col("o_orderkey").alias("incident_key"),
                    ticket_no(F.col("o_orderkey")).alias("external_id"),
                    "priority", sev.alias("severity"), rules.flow_of(sev).alias("flow"),
                    _opened(F.col("o_orderkey")).alias("opened_at"),
                    (F.col("o_custkey") % 150).alias("entity"))


def runs(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice",
                                          F.substring("o_orderpriority", 1, 1).alias("priority"))
    status = rules.lookup(F.col("o_orderstatus"), {"F": "completed", "P": "running"}, "failed")
    dur = F.floor(F.col("o_totalprice") / 10)
    start = _opened(F.col("o_orderkey"))
    return o.select(
        F.col("o_orderkey").alias("run_id"), ticket_no(F.col("o_orderkey")).alias("external_id"),
        status.alias("status"),
        rules.flow_of(rules.severity_of_priority(F.col("priority"))).alias("flow"),
        start.alias("started_at"),
        F.when(status == "completed",
               start + F.make_dt_interval(secs=dur / F.lit(1000).cast("decimal(10,0)"))
               ).alias("completed_at"),
        dur.alias("duration_ms"))


STEP_SEQ = ["l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice"]


def step_log(spark: SparkSession, sf: str) -> DataFrame:
    """Change log of run steps: several rows per (run, agent)."""
    li = table(spark, sf, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("agent_num"),
        F.struct(*STEP_SEQ).alias("seq"),
        rules.lookup(F.col("l_returnflag"), {"A": "completed", "N": "running"}, "failed")
             .alias("status"),
        (F.col("l_quantity") * 1000).cast("bigint").alias("duration_ms"))


def _k(props: Column) -> Column:
    return F.get_json_object(props, "$.k").cast("int")


def logs(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "props")
    level = rules.lookup(F.col("event_type"),
                         {"error": "ERROR", "purchase": "WARN", "signup": "SEVERE"}, "INFO")
    content = rules.lookup(_k(F.col("props")) % 5,
                           {0: "connection timeout", 1: "heap oom", 2: "deploy failed",
                            3: "slow request"}, "ok")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"),
                    F.col("user_id").alias("entity"), level.alias("level"),
                    content.alias("content"))


def run_events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "props", "value")
    kind = rules.lookup(F.col("event_type"),
                        {"view": "agent_start", "click": "agent_done", "error": "agent_error",
                         "purchase": "pipeline_complete"}, "pipeline_started")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"),
                    F.col("user_id").alias("run_id"), kind.alias("event"),
                    (_k(F.col("props")) % 7 + 1).alias("agent_num"), "value")


def problem_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as alerts of the first source, with an alert kind and a state."""
    e = table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "props")
    k = _k(F.col("props"))
    kind = rules.lookup(F.col("event_type"),
                        {"error": "error", "click": "Performance", "view": "AVAILABILITY",
                         "purchase": "resource", "signup": "weird"}, "INFO")
    return e.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id",
                    F.concat(F.lit("PRB-"), F.col("user_id")).alias("problem_id"),
                    F.when(k % 10 == 9, "custom").when(k % 10 == 8, "info").otherwise(kind)
                     .alias("kind"),
                    F.when(k % 4 == 0, "Resolved").otherwise("OPEN").alias("status"),
                    F.concat(F.lit("host-"), F.col("user_id") % 20).alias("host"),
                    F.when(k % 3 == 0, F.concat(F.lit("svc-"), k % 6)).alias("service"))


def closed_incidents(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select("doc_id", "text", "lang", "source")
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    i = F.col("doc_id")
    notes = F.concat(
        F.when(i % 5 == 0, "<p>").otherwise(""), F.col("text"),
        F.when(i % 3 == 0, "\nstep 1: restart the service").otherwise(""),
        F.when(i % 4 == 0, F.format_string(" MRN-%08d", i)).otherwise(""),
        F.when(i % 5 == 0, "</p>").otherwise(""))
    code = (F.when(i % 7 == 0, "Duplicate").when(i % 7 == 1, "User Error - No Action")
             .when(F.col("quality") == 1, "Solved (Permanently)")
             .when(F.col("quality") == 0, "Solved (Workaround)"))
    closed = ts(EPOCH) + F.make_dt_interval(mins=((i * 97) % 43200).cast("int"))
    return d.join(lab, "doc_id", "left").select(
        F.format_string("INC%07d", i).alias("number"), i.alias("doc_id"),
        F.get(F.split("text", "\n"), F.lit(0)).alias("short_description"),
        F.concat(F.lit("reported in "), F.col("lang")).alias("description"),
        notes.alias("close_notes"), code.alias("close_code"),
        F.concat(F.lit(" "), F.col("source")).alias("assignment_group"),
        F.when(i % 3 == 1, F.lit("")).otherwise(F.col("lang")).alias("category"),
        F.lit(None).cast("string").alias("subcategory"),
        F.when(i % 50 == 7, F.date_format(closed, "yyyy-MM-dd"))
         .otherwise(F.date_format(closed, "yyyy-MM-dd HH:mm:ss")).alias("closed_at"))


def planted(embedding: Column, label: Column, strength: float | Column = PLANT) -> Column:
    """strength * vector + the unit axis of the label."""
    s = F.lit(strength) if isinstance(strength, float) else strength
    return F.transform(embedding.cast("array<double>"),
                       lambda x, i: s * x + F.when(i == label, 1.0).otherwise(0.0))


def team_vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    return e.select(F.format_string("N%06d", F.col("vec_id")).alias("number"),
                    F.concat(F.lit("team"), F.col("label")).alias("team"),
                    F.col("vec_id"), F.col("label"),
                    planted(F.col("embedding"), F.col("label")).alias("vec"))


def existing_articles(spark: SparkSession, sf: str) -> DataFrame:
    """One active article per label: the first vector, planted at a strength by label."""
    e = table(spark, sf, "embeddings").groupBy("label").agg(
        F.min("vec_id").alias("vec_id"), F.min_by("embedding", "vec_id").alias("embedding"))
    strength = (F.when(F.col("label") % 3 == 0, 0.2).when(F.col("label") % 3 == 1, 0.5)
                 .otherwise(1.0))
    return e.select(F.concat(F.lit("art-"), F.col("label")).alias("article_id"),
                    F.concat(F.lit("sig-"), F.col("label")).alias("cluster_signature"),
                    F.col("label"), (F.col("label") % 4 != 3).alias("is_active"),
                    F.concat(F.lit("team"), F.col("label")).alias("team"),
                    F.concat(F.lit("cat"), F.col("label") % 4).alias("category"),
                    F.round(F.col("label") / 9.0, 6).alias("confidence"),
                    planted(F.col("embedding"), F.col("label"), strength).alias("vec"))


def recommendations(spark: SparkSession, sf: str) -> DataFrame:
    e = (table(spark, sf, "events").select("event_id", "ts", "user_id", "event_type", "value")
         .where(F.col("event_type").isin("click", "purchase")))
    score = F.least(F.col("value") / 100, F.lit(1.0)) * (F.col("user_id") % 50) / 50
    return e.select("event_id", F.col("user_id").alias("article_id"),
                    F.when(F.col("user_id") % 25 != 24, score).alias("feedback_score"),
                    F.col("ts").cast("timestamp").alias("created_at"))


def kb_documents(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents")
    return d.select(F.lit("doc").alias("source_type"),
                    F.col("doc_id").cast("string").alias("source_id"),
                    F.concat(F.lit("Document "), F.col("doc_id")).alias("title"),
                    F.col("text").alias("content"), F.col("lang"), F.col("source"))


def conversations(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")


def resolutions(spark: SparkSession, sf: str) -> DataFrame:
    """Root-cause results, one per completed or failed run."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    i = F.col("o_orderkey")
    cat = rules.lookup((i % 6).cast("int"),
                       {0: "db_connection", 1: "memory", 2: "deployment", 3: "network", 4: "config"},
                       "unknown")
    return o.where(F.col("o_orderstatus") != "P").select(
        i.alias("run_id"), cat.alias("root_cause_cat"),
        ((F.col("o_totalprice").cast("bigint") % 111)).cast("int").alias("confidence"),
        (i % 7).cast("int").alias("rating"))
