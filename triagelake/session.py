"""Session settings and lineage cuts shared by every job."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

RUNTIME_CONF = {
    # One clock for every timestamp; AQE re-plans joins, splits skewed ones and
    # coalesces small shuffle partitions.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Vector columns travel to Python in batches of this many rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "4096",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "triagelake", master: str | None = None,
                  shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """A session with the runtime settings above; `master` is left to spark-submit by default."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    # Checkpoint files go when nothing refers to them any more.
    b = b.config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    for k, v in {**RUNTIME_CONF, **(extra or {})}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session somebody else created."""
    for k, v in RUNTIME_CONF.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder for checkpoints and intermediate tables.

    It is what the cluster names in spark.checkpoint.dir; where that is unset, a folder
    in the warehouse. A warehouse on the machine's own disk will do for a local master only.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root
    warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
    if not spark.sparkContext.master.startswith("local") and (warehouse.startswith("file:") or "://" not in warehouse):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{warehouse}/_scratch"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared store."""
    return f"{checkpoint_root(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of any executor."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(checkpoint_root(spark))
    return df.checkpoint(eager=True)


def cut_round(df: DataFrame) -> DataFrame:
    """A reliable checkpoint for a table that goes from one round of a loop to the next.

    A plain checkpoint keeps the size Spark estimated for its plan. Every join multiplies the
    sizes of its sides, so in a loop that joins a table with itself the digits of that number
    double each round until they fill the driver's memory. This one starts without an estimate.
    """
    cut = cut_lineage(df)._jdf
    return DataFrame(df.sparkSession._jsparkSession.createDataFrame(cut.toJavaRDD(), cut.schema()), df.sparkSession)


def cut_counted(df: DataFrame, **measures: Column) -> tuple[DataFrame, dict[str, int]]:
    """A reliable checkpoint and aggregates of its rows, observed while it is written."""
    seen = Observation()
    cut = cut_lineage(df.observe(seen, *[c.alias(name) for name, c in measures.items()]))
    return cut, seen.get
