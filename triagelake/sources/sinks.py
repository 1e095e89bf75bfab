"""Writers: snapshot tables, retention, idempotent batches, text export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.operators.keyed import top_per_key

# Entries kept per run and overall, and the age limit.
KEEP_PER_RUN, KEEP_GLOBAL, EXPIRE_SECONDS = 500, 5000, 3600


def retain_per_run(events: DataFrame, keep: int = KEEP_PER_RUN) -> DataFrame:
    """The newest entries of each run."""
    return top_per_key(events, ["run_id"], [F.col("ts").desc(), F.col("event_id").desc()], keep)


def retain_global(events: DataFrame, keep: int = KEEP_GLOBAL) -> DataFrame:
    return events.orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(keep)


def expire_runs(events: DataFrame, as_of: Column, seconds: int = EXPIRE_SECONDS) -> DataFrame:
    """Entries of runs that had an event within the expiry time."""
    live = events.groupBy("run_id").agg(F.max("ts").alias("_last")).where(
        F.col("_last") >= as_of - F.make_dt_interval(secs=F.lit(seconds))).select("run_id")
    return events.join(live, "run_id", "left_semi")


class SnapshotTable:
    """A mutable table as immutable snapshots under one folder.

    A commit or append writes a new folder and then a pointer entry (one file, the
    folders of the version); readers take the newest version, so a failed write leaves the last snapshot in force and no
    path is overwritten while it is read. Pointers are tiny parquet rows, written
    by Spark, so any shared file system will do.
    """

    def __init__(self, spark: SparkSession, root: str, schema=None):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema

    def _pointers(self) -> DataFrame | None:
        try:
            return self.spark.read.schema("version bigint, path string").parquet(f"{self.root}/_pointer")
        except Exception as e:                       # no commit yet
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise

    def current_version(self) -> int:
        p = self._pointers()
        v = None if p is None else p.agg(F.max("version")).first()[0]
        return 0 if v is None else int(v)

    def _paths(self, version: int) -> list[str]:
        rows = self._pointers().where(F.col("version") == version).select("path").collect()
        return sorted(r["path"] for r in rows)

    def read(self) -> DataFrame:
        v = self.current_version()
        if v == 0:
            if self.schema is None:
                raise FileNotFoundError(f"no snapshot in {self.root}")
            return self.spark.createDataFrame([], self.schema)
        reader = self.spark.read if self.schema is None else self.spark.read.schema(self.schema)
        return reader.parquet(*self._paths(v))

    def _point(self, version: int, paths: list[str]) -> int:
        (self.spark.createDataFrame([(version, p) for p in paths], "version bigint, path string")
             .coalesce(1).write.mode("append").parquet(f"{self.root}/_pointer"))
        return version

    def commit(self, df: DataFrame) -> int:
        """Replace the content."""
        v = self.current_version() + 1
        path = f"{self.root}/v={v:08d}"
        df.write.mode("overwrite").parquet(path)
        return self._point(v, [path])

    def append(self, df: DataFrame) -> int:
        """Add rows; what is stored is pointed to again, not rewritten."""
        v = self.current_version() + 1
        path = f"{self.root}/v={v:08d}"
        df.write.mode("overwrite").parquet(path)
        return self._point(v, [*(self._paths(v - 1) if v > 1 else []), path])


def append_batch(df: DataFrame, batch_id: int, path: str) -> None:
    """Idempotent micro-batch write: a replayed batch replaces its own folder."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def export_articles(markup: DataFrame, path: str, column: str = "body") -> None:
    markup.select(column).write.mode("overwrite").text(path)
