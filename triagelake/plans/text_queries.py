"""Queries: text cleaning, scoring, documents and chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake import schemas
from triagelake.functions import text
from triagelake.functions.evaluate import once
from triagelake.operators import articles, cleaning, documents
from triagelake.plans import sqltext as S
from triagelake.plans.registry import query
from triagelake.plans.page_sync import PageStore, sync_pages
from triagelake.session import scratch
from triagelake.sources import domain as D


@query()
def strip_html_parser(spark, sf):
    p = D.table(spark, sf, "pages").select("page_id", "html")
    return p.select("page_id", F.sha2(text.strip_markup(F.col("html")), 256).alias("digest"))


@query(f"""SELECT doc_id, sha256({S.collapse("replace(text, ' ', '  ') || chr(10) || chr(10) || ' '")}) AS digest FROM documents""")
def collapse_whitespace(spark, sf):
    """The texts hold no repeated blanks, so every blank is doubled first."""
    d = D.table(spark, sf, "documents").select(
        "doc_id", F.concat(F.replace("text", F.lit(" "), F.lit("  ")), F.lit("\n\n ")).alias("t"))
    return d.select("doc_id", F.sha2(text.collapse_whitespace(F.col("t")), 256).alias("digest"))


@query(f"""WITH {S.NORMALIZED} SELECT number, short_description, description, close_code, assignment_group, category,
  strftime(closed_ts, '%Y-%m-%dT%H:%M:%S') AS closed_at_iso, sha256(close_notes) AS notes_digest FROM norm""")
def normalize_incidents(spark, sf):
    n = cleaning.normalize_incidents(D.closed_incidents(spark, sf))
    return n.select("number", "short_description", "description", "close_code", "assignment_group", "category",
                    "closed_at_iso", F.sha2("close_notes", 256).alias("notes_digest"))


PII = "close_notes || ' DOB:1/2/1980 NPI 1234567890 ICD-10 E11.9 patient id:' || doc_id || ' ssn 123-45-6789'"


@query(f"""WITH {S.CLOSED}, x AS (SELECT number, {PII} AS t FROM closed)
  SELECT number, sha256({S.scrub('t')}) AS digest, {S.markers('t')} AS redactions FROM x""")
def phi_scrub(spark, sf):
    c = D.closed_incidents(spark, sf).select("number", F.concat(
        "close_notes", F.lit(" DOB:1/2/1980 NPI 1234567890 ICD-10 E11.9 patient id:"), "doc_id",
        F.lit(" ssn 123-45-6789")).alias("t"))
    c = once(c, {"clean": text.scrub(F.col("t"))})
    return c.select("number", F.sha2("clean", 256).alias("digest"),
                    text.scrub_count(F.col("t"), F.col("clean")).alias("redactions"))


@query(f"WITH {S.SCORED} SELECT number, quality, redactions FROM scored")
def quality_score(spark, sf):
    return cleaning.prepare_incidents(D.closed_incidents(spark, sf)).select("number", "quality", "redactions")


@query(f"""WITH {S.SCORED} SELECT (SELECT count(*) FROM documents) AS extracted, count(*) FILTER (quality >= 0.4) AS kept,
  (SELECT count(*) FROM documents) - count(*) FILTER (quality >= 0.4) AS filtered FROM scored""")
def quality_gate_counts(spark, sf):
    return cleaning.gate_counts(D.closed_incidents(spark, sf))


@query(f"""WITH {S.SCORED} SELECT number, sha256(short_description || chr(10) || chr(10) || description || chr(10) || chr(10)
  || 'Resolution: ' || close_notes) AS digest FROM scored WHERE quality >= 0.4""")
def embedding_text(spark, sf):
    kept = cleaning.quality_gate(cleaning.prepare_incidents(D.closed_incidents(spark, sf)))
    return kept.select("number", F.sha2(text.embedding_text(
        F.col("short_description"), F.col("description"), F.col("close_notes")), 256).alias("digest"))


_PRESENT = ["number", "short_description", "description", "close_notes", "close_code", "assignment_group",
            "category", "subcategory", "closed_at"]


@query(f"WITH {S.CLOSED}, c AS (SELECT *, NULL AS subcategory, '' AS closed_at FROM closed) "
       + " UNION ALL ".join(f"SELECT '{c}' AS field, true AS present, count({c}) AS non_null FROM c" for c in _PRESENT)
       + " UNION ALL SELECT 'u_source_tool', false, 0")
def field_coverage(spark, sf):
    return cleaning.field_coverage(D.closed_incidents(spark, sf), schemas.CLOSED_FIELDS)


@query(f"WITH {S.CLOSED} SELECT number, {S.markers('close_notes')} AS leaks FROM closed WHERE {S.markers('close_notes')} > 0")
def article_leak_scan(spark, sf):
    """Closed notes as stored article text, before scrubbing."""
    c = D.closed_incidents(spark, sf)
    return articles.leak_scan(c, "number", [F.col("close_notes"), F.col("short_description")])


# ---- documents ---------------------------------------------------------------

@query(f"""WITH p AS (SELECT page_id, {S.strip_edges("regexp_replace(html, '<[^>]+>', ' ', 'g')")} AS content FROM pages),
  q AS (SELECT 'https://kb.local/pages/' || page_id AS source_url, content, {S.words('content')} AS w FROM p WHERE content <> '')
  SELECT source_url, chunk_index, token_count, sha256(chunk) AS digest FROM ({S.chunk_rows('q', 'source_url', 'content')})""")
def page_ingest(spark, sf):
    docs = documents.page_documents(D.table(spark, sf, "pages"))
    c = documents.chunk_documents(docs, ["source_url"])
    return c.select("source_url", "chunk_index", "token_count", F.sha2("chunk", 256).alias("digest"))


@query(f"""WITH p AS (SELECT page_id, {S.strip_edges("regexp_replace(html, '<[^>]+>', ' ', 'g')")} AS content FROM pages),
  own AS (SELECT page_id, content, {S.words('content')} AS w FROM p WHERE content <> ''
    QUALIFY row_number() OVER (PARTITION BY content ORDER BY (page_id % 3 = 0)::INT, CAST(page_id AS VARCHAR)) = 1)
  SELECT page_id, chunk_index, token_count, sha256(chunk) AS digest, token_count > 0 AS embedded
  FROM ({S.chunk_rows('own', 'page_id', 'content')})""")
def page_sync(spark, sf):
    """Stored chunks after two runs of the page job: two thirds of the pages, then all of them."""
    store, pages = PageStore(spark, scratch(spark, "pages")), D.table(spark, sf, "pages")
    sync_pages(store, pages.where("page_id % 3 <> 0"))
    sync_pages(store, pages)
    return store.current_chunks().select(
        F.col("source_id").cast(pages.schema["page_id"].dataType).alias("page_id"), "chunk_index", "token_count",
        F.sha2("chunk", 256).alias("digest"), F.exists("embedding", lambda x: x != 0).alias("embedded"))


@query("""WITH log AS (SELECT CAST(doc_id AS VARCHAR) AS source_id, text AS content, 1 AS seq FROM documents
    UNION ALL SELECT CAST(doc_id AS VARCHAR), text || ' (revised)', 2 FROM documents JOIN labels USING (doc_id) WHERE quality = 0
    UNION ALL SELECT 'page-' || page_id, html, 1 FROM pages),
  latest AS (SELECT source_id, seq, sha256(content) AS h, row_number() OVER (PARTITION BY source_id ORDER BY seq DESC) AS rn FROM log),
  o AS (SELECT *, first_value(source_id) OVER (PARTITION BY h ORDER BY seq, source_id) AS owner FROM latest WHERE rn = 1)
  SELECT source_id, h AS content_hash, CASE WHEN owner = source_id THEN 'stored' ELSE 'rejected' END AS outcome FROM o""")
def document_upsert(spark, sf):
    d = D.table(spark, sf, "documents").select("doc_id", "text")
    bad = D.table(spark, sf, "labels").where(F.col("quality") == 0).select("doc_id")
    p = D.table(spark, sf, "pages")
    one = F.lit("kb").alias("source_type")
    log = (d.select(one, F.col("doc_id").cast("string").alias("source_id"), F.col("text").alias("content"),
                    F.lit(1).alias("seq"))
           .unionByName(d.join(bad, "doc_id").select(
               one, F.col("doc_id").cast("string").alias("source_id"),
               F.concat("text", F.lit(" (revised)")).alias("content"), F.lit(2).alias("seq")))
           .unionByName(p.select(one, F.concat(F.lit("page-"), "page_id").alias("source_id"),
                                 F.col("html").alias("content"), F.lit(1).alias("seq"))))
    stored, rejected = documents.document_upsert(log, ["seq"])
    return (stored.select("source_id", "content_hash", F.lit("stored").alias("outcome"))
            .unionByName(rejected.select("source_id", "content_hash", F.lit("rejected").alias("outcome"))))


DOC_WORDS = f"dw AS (SELECT doc_id, text, {S.words('text')} AS w FROM documents)"


@query(f"""WITH {DOC_WORDS} SELECT doc_id, chunk_index, token_count, sha256(chunk) AS digest
  FROM ({S.chunk_rows('dw', 'doc_id', 'text')})""")
def chunk_documents(spark, sf):
    c = documents.chunk_documents(D.table(spark, sf, "documents").select("doc_id", "text"), ["doc_id"], "text")
    return c.select("doc_id", "chunk_index", "token_count", F.sha2("chunk", 256).alias("digest"))


@query(f"""WITH {DOC_WORDS}, old AS ({S.chunk_rows('dw', 'doc_id', 'text')}),
  dn AS (SELECT doc_id, t AS text, {S.words('t')} AS w FROM (SELECT doc_id, split_part(text, chr(10), 1) AS t
    FROM documents JOIN labels USING (doc_id) WHERE quality = 0)),
  new AS ({S.chunk_rows('dn', 'doc_id', 'text')})
  SELECT doc_id, chunk_index, token_count FROM old WHERE doc_id NOT IN (SELECT doc_id FROM new)
  UNION ALL SELECT doc_id, chunk_index, token_count FROM new""")
def chunk_upsert(spark, sf):
    """Rejected documents shrink to their first line; their stale tail chunks must go."""
    from triagelake.operators.keyed import replace_children
    d = D.table(spark, sf, "documents").select("doc_id", "text")
    bad = D.table(spark, sf, "labels").where(F.col("quality") == 0).select("doc_id")
    short = d.join(bad, "doc_id").select("doc_id", F.get(F.split("text", "\n"), F.lit(0)).alias("text"))
    old = documents.chunk_documents(d, ["doc_id"], "text")
    new = documents.chunk_documents(short, ["doc_id"], "text")
    return replace_children(old, new, "doc_id").select("doc_id", "chunk_index", "token_count")


@query(f"""WITH dw AS (SELECT doc_id, text, {S.words('text')} AS w FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
  SELECT doc_id, chunk_index, token_count FROM ({S.chunk_rows('dw', 'doc_id', 'text')})""")
def missing_chunks(spark, sf):
    """Labelled documents count as indexed; the others are chunked now."""
    d = D.table(spark, sf, "documents").select("doc_id", "text")
    have = D.table(spark, sf, "labels").select("doc_id")
    todo = documents.missing_chunks(d, have, ["doc_id"])
    return documents.chunk_documents(todo, ["doc_id"], "text").select("doc_id", "chunk_index", "token_count")


@query("SELECT doc_id, true AS unit_length FROM documents")
def hash_embedding(spark, sf):
    """Offline embedding of every document: dimension and length of each vector."""
    from triagelake.functions.vectors import norm
    d = documents.hash_embedding(D.table(spark, sf, "documents").select("doc_id", "text"), "text")
    return d.select("doc_id", ((F.abs(norm(F.col("embedding")) - 1) < 1e-9)
                               & (F.size("embedding") == 64)).alias("unit_length"))


def word_length_embedder(texts):
    """Injected embedder of the batch query: counts of words by length."""
    import numpy as np
    out = np.zeros((len(texts), 8))
    for i, t in enumerate(texts):
        for w in t.split():
            out[i, min(len(w), 8) - 1] += 1
    return out.tolist()


@query(f"""SELECT doc_id, CAST(len(w) AS DOUBLE) AS total, CAST(len(list_filter(w, lambda x: length(x) = 2)) AS DOUBLE) AS twos
  FROM (SELECT doc_id, {S.words('text')} AS w FROM documents)""")
def embed_batch(spark, sf):
    d = D.table(spark, sf, "documents").select("doc_id", "text")
    e = documents.embed_texts(d, "text", word_length_embedder, 8)
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return e.select("doc_id", total.alias("total"), F.col("embedding")[1].cast("double").alias("twos"))
