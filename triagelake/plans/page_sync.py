"""Knowledge pages as one incremental job: documents, chunks and vectors of what changed.

The change set is what differs by content hash from the stored documents. It alone is
chunked and embedded. Chunks belong to a content hash, not to a page: a page's new
content replaces its chunks by pointing at others, and content that comes back is not
embedded again. Both tables are appended to: chunks first, then the documents that
make them visible, so a run that fails between leaves nothing half done and its repeat
adds what is missing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from triagelake.operators import documents
from triagelake.operators.documents import DOC_KEYS
from triagelake.operators.keyed import latest_per_key
from triagelake.session import cut_lineage
from triagelake.sources.sinks import SnapshotTable

DOCUMENT = ("source_type string, source_id string, source_url string, title string, content string, content_hash string, "
            "run bigint")
CHUNK = "content_hash string, chunk_index int, token_count int, chunk string, embedding array<double>"


class PageStore:
    def __init__(self, spark: SparkSession, root: str, dim: int = 64):
        self.documents = SnapshotTable(spark, f"{root}/documents", DOCUMENT)
        self.chunks = SnapshotTable(spark, f"{root}/chunks", CHUNK)
        self.dim = dim

    def current(self) -> DataFrame:
        """The newest stored version of each document."""
        return latest_per_key(self.documents.read(), DOC_KEYS, ["run"])

    def current_chunks(self) -> DataFrame:
        """Chunks of the current documents with their keys."""
        return self.current().select(*DOC_KEYS, "source_url", "content_hash").join(self.chunks.read(), "content_hash")


def change_set(store: PageStore, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected) documents whose content differs from what is stored.

    A content hash belongs to one document: to the one that has it, else to the
    smallest key among those that want it."""
    wanted = documents.with_hash(docs)
    stored = store.current().select(*DOC_KEYS, F.col("content_hash").alias("_old"))
    changed = wanted.join(stored, DOC_KEYS, "left").where(~F.col("content_hash").eqNullSafe(F.col("_old"))).drop("_old")
    first = changed.groupBy("content_hash").agg(F.min(F.struct(*DOC_KEYS)).alias("_first"))
    held = store.current().groupBy("content_hash").agg(F.min(F.struct(*DOC_KEYS)).alias("_held"))
    judged = cut_lineage(changed.join(first, "content_hash").join(held, "content_hash", "left").withColumn(
        "_mine", F.col("_held").isNull() & (F.col("_first") == F.struct(*DOC_KEYS))))
    keep = judged.drop("_mine", "_first", "_held")
    return keep.where(judged["_mine"]), keep.where(~judged["_mine"])


def sync_pages(store: PageStore, pages: DataFrame) -> dict[str, int]:
    """Brings the store up to date with (page_id, url, html); counts of documents and chunks written.

    A run without changes writes nothing."""
    docs = documents.page_documents(pages)
    docs = latest_per_key(docs, DOC_KEYS, ["content", "source_url"])          # a repeated page counts once
    accepted, rejected = change_set(store, docs)
    if accepted.isEmpty():
        return {"documents": 0, "chunks": 0, "rejected": rejected.count()}
    fresh = accepted.join(store.chunks.read().select("content_hash"), "content_hash", "left_anti")
    chunks = documents.chunk_documents(fresh, ["content_hash"])
    made, seen = Observation("chunks"), Observation("documents")
    embedded = documents.hash_embedding(chunks, "chunk", store.dim).select(
        "content_hash", "chunk_index", "token_count", "chunk", "embedding")
    store.chunks.append(embedded.observe(made, F.count(F.lit(1)).alias("n")))
    run = store.documents.current_version() + 1
    rows = accepted.withColumn("run", F.lit(run).cast("long")).select(*[c.split()[0] for c in DOCUMENT.split(", ")])
    store.documents.append(rows.observe(seen, F.count(F.lit(1)).alias("n")))
    return {"documents": seen.get["n"], "chunks": made.get["n"], "rejected": rejected.count()}
