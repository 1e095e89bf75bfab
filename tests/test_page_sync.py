"""The page job: changes only, replaced chunks, one owner of a content, a repeat that writes nothing."""

from pyspark.sql import functions as F

from triagelake.operators import documents
from triagelake.plans.page_sync import PageStore, sync_pages

PAGE = "page_id long, url string, html string"


def html(body):
    return f"<html><title>t</title><p>{body}</p></html>"


def test_page_sync(spark, tmp_path):
    store = PageStore(spark, str(tmp_path / "kb"))
    long = " ".join(f"word{i}" for i in range(900))
    pages = [(1, "u", html(long)), (2, "u", html("short page")), (3, "u", html("short page")), (4, "u", "<br>"), (5, "u", html("fifth")),
             (5, "u", html("fifth")), (6, "u", None)]

    def sync(rows):
        return sync_pages(store, spark.createDataFrame(rows, PAGE))

    def chunks():
        return {(r.source_id, r.chunk_index): r.chunk for r in store.current_chunks().collect()}

    assert sync(pages) == {"documents": 3, "chunks": 5, "rejected": 1}
    first = chunks()
    assert set(first) == {("1", 0), ("1", 1), ("1", 2), ("2", 0), ("5", 0)}
    versions = store.documents.current_version(), store.chunks.current_version()
    assert sync(pages) == {"documents": 0, "chunks": 0, "rejected": 1}
    assert (store.documents.current_version(), store.chunks.current_version()) == versions
    # A long page shrinks: its tail chunks go; the others are not written again.
    assert sync([(1, "u", html("now short")), *pages[1:]]) == {"documents": 1, "chunks": 1, "rejected": 1}
    assert set(chunks()) == {("1", 0), ("2", 0), ("5", 0)} and "now short" in chunks()["1", 0]
    # It comes back: nothing is embedded again.
    assert sync(pages) == {"documents": 1, "chunks": 0, "rejected": 1}
    assert chunks() == first
    want = documents.hash_embedding(store.current_chunks().select("source_id", "chunk_index", "chunk"), "chunk", 64, "again")
    same = want.join(store.current_chunks(), ["source_id", "chunk_index"])
    assert same.count() == 5 and same.where(~F.col("again").eqNullSafe(F.col("embedding"))).count() == 0


def test_a_failure_before_the_documents_is_made_good(spark, tmp_path, monkeypatch):
    store = PageStore(spark, str(tmp_path / "kb"))
    rows = spark.createDataFrame([(1, "u", html("one")), (2, "u", html("two"))], PAGE)
    with monkeypatch.context() as m:
        m.setattr(store.documents, "append", lambda df: 1 / 0)
        try:
            sync_pages(store, rows)
        except ZeroDivisionError:
            pass
    assert store.current_chunks().count() == 0
    assert sync_pages(store, rows) == {"documents": 2, "chunks": 0, "rejected": 0}
    assert store.current_chunks().count() == 2


def test_no_pages(spark, tmp_path):
    store = PageStore(spark, str(tmp_path / "kb"))
    assert sync_pages(store, spark.createDataFrame([], PAGE)) == {"documents": 0, "chunks": 0, "rejected": 0}
    assert store.current_chunks().count() == 0
