"""Queries: article life cycle, root-cause records, audits, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from triagelake.functions import rules, scoring
from triagelake.operators import articles, audit, clusters, loganalysis, rootcause, search
from triagelake.operators.keyed import ordinal
from triagelake.plans import sqltext as S
from triagelake.plans.registry import query
from triagelake.plans.state_queries import ANALYSED, RES
from triagelake.plans.vector_queries import _MEDOID, members
from triagelake.sources import domain as D

# ---- prompts, generation, validation ------------------------------------------


def representatives(spark, sf):
    """Representatives of the label clusters with the text of the incident of the same key."""
    m = members(spark, sf)
    r = clusters.representatives(m, clusters.medoids(m))
    keys = D.team_vectors(spark, sf).select("number", "vec_id")
    c = D.closed_incidents(spark, sf).select(
        F.col("doc_id").alias("vec_id"), "short_description", "description", "close_notes", "close_code")
    return r.join(keys, "number").join(c, "vec_id", "left").select(
        "cluster", "rank", "number", "team",
        *[F.coalesce(x, F.lit("")).alias(x) for x in ("short_description", "description", "close_notes")],
        "close_code")


REPS = f"""{S.VEC}, {S.CLOSED}, {_MEDOID}, reps AS (SELECT cluster, v.number, v.team, v.vec_id, row_number() OVER (PARTITION BY cluster
    ORDER BY v.number = medoid DESC, round(list_cosine_similarity(v.vec, m.vec), 9) DESC, v.number) AS rn
  FROM md JOIN vec m ON m.number = medoid JOIN vec v ON v.label = cluster),
  rt AS (SELECT reps.*, coalesce(short_description, '') AS sd, coalesce(description, '') AS de, coalesce(close_notes, '') AS cn,
    close_code FROM reps LEFT JOIN closed ON doc_id = vec_id WHERE rn <= 5)"""


@query(f"""WITH {REPS} SELECT cluster, sha256('{articles.PROMPT_RULES}' || string_agg('--- ' || number || ' (' || team || ') ---'
  || chr(10) || 'Short: ' || sd || chr(10) || 'Description: ' || de || chr(10) || 'Resolution: ' || cn || chr(10)
  || 'Close-code: ' || coalesce(nullif(close_code, ''), 'unknown') || chr(10), chr(10) ORDER BY rn)) AS digest FROM rt GROUP BY 1""")
def synthesis_prompt(spark, sf):
    p = articles.synthesis_prompts(representatives(spark, sf))
    return p.select("cluster", F.sha2("prompt", 256).alias("digest"))


def echo_generator(prompt: str) -> str:
    """Stand-in for a model in the batch query: an article from the prompt's first case."""
    import json
    first = prompt.split("\nIncidents:\n", 1)[1]
    team = first.split("(", 1)[1].split(")", 1)[0]
    if team.endswith("9"):
        raise ValueError("no answer")
    return json.dumps({"title": f"Issue of {team}", "problem_summary": f"Recurring problem of {team}.",
                       "resolution_steps": [{"step": 1, "action": "restart"}], "keywords": [team],
                       "assignment_group": team, "confidence_self_rating": 0.6})


@query("""SELECT label AS cluster, label <> 9 AS valid, CASE WHEN label <> 9 THEN 'Issue of team' || label END AS title,
  CASE WHEN label = 9 THEN 'ValueError: no answer' END AS error FROM (SELECT DISTINCT label FROM embeddings)""")
def synthesize_articles(spark, sf):
    g = articles.generate(articles.synthesis_prompts(representatives(spark, sf)), echo_generator)
    v = articles.validate_articles(g)
    return v.select("cluster", "valid", F.col("article.title").alias("title"), "error")


_RAW = """raw AS (SELECT doc_id, '{"title":"' || repeat('t', doc_id % 210) || '","problem_summary":"' || repeat('s', n_chars % 40)
  || '","resolution_steps":' || CASE doc_id % 4 WHEN 0 THEN '[]' WHEN 1 THEN '[{"step":0,"action":"a"}]' WHEN 2 THEN '[{"step":1,"action":""}]'
     ELSE '[{"step":1,"action":"a"},{"step":2,"action":"b","command":"c"}]' END
  || ',"keywords":["' || lang || '"],"assignment_group":"' || CASE WHEN doc_id % 9 = 0 THEN '' ELSE source END
  || '","confidence_self_rating":' || (doc_id % 13) || 'e-1' || CASE WHEN lang = 'de' THEN ',"owner":"x"' ELSE '' END || '}' AS j, n_chars FROM documents)"""


@query(f"""WITH {_RAW}, x AS (SELECT doc_id, j, json_extract_string(j, '$.title') AS t, json_extract_string(j, '$.problem_summary') AS s,
    json_extract(j, '$.resolution_steps') AS st, json_extract_string(j, '$.assignment_group') AS g,
    CAST(json_extract_string(j, '$.confidence_self_rating') AS DOUBLE) AS c, json_keys(j) AS ks FROM raw)
  SELECT doc_id, array_to_string(list_filter([
    CASE WHEN NOT length(t) BETWEEN 5 AND 200 THEN 'title' END, CASE WHEN length(s) < 20 THEN 'problem_summary' END,
    CASE WHEN json_array_length(st) < 1 OR EXISTS (SELECT 1 FROM (SELECT unnest(CAST(st AS JSON[])) AS e)
      WHERE CAST(json_extract_string(e, '$.step') AS INT) < 1 OR json_extract_string(e, '$.action') = '') THEN 'resolution_steps' END,
    CASE WHEN length(g) < 1 THEN 'assignment_group' END, CASE WHEN NOT c BETWEEN 0.0 AND 1.0 THEN 'confidence_self_rating' END,
    CASE WHEN list_contains(ks, 'owner') THEN 'extra_fields' END], lambda p: p IS NOT NULL), ',') AS problems FROM x""")
def article_validation(spark, sf):
    d = D.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    i = F.col("doc_id")
    steps = rules.lookup((i % 4).cast("int"), {0: "[]", 1: '[{"step":0,"action":"a"}]', 2: '[{"step":1,"action":""}]'},
                         '[{"step":1,"action":"a"},{"step":2,"action":"b","command":"c"}]')
    j = F.concat(
        F.lit('{"title":"'), F.repeat(F.lit("t"), (i % 210).cast("int")), F.lit('","problem_summary":"'),
        F.repeat(F.lit("s"), (F.col("n_chars") % 40).cast("int")), F.lit('","resolution_steps":'), steps,
        F.lit(',"keywords":["'), "lang", F.lit('"],"assignment_group":"'),
        F.when(i % 9 == 0, F.lit("")).otherwise(F.col("source")), F.lit('","confidence_self_rating":'),
        i % 13, F.lit("e-1"), F.when(F.col("lang") == "de", ',"owner":"x"').otherwise(""), F.lit("}"))
    v = articles.validate_articles(d.select("doc_id", j.alias("article_json")))
    return v.select("doc_id", F.array_join("problems", ",").alias("problems"))


@query(f"""WITH {S.CLOSED} SELECT number, sha256('Case ' || number || chr(10) || short_description) AS title_digest,
  sha256('Case ' || number || chr(10) || chr(10) || short_description || chr(10) || chr(10) || 'Resolution: look ' || description) AS full_digest
  FROM closed""")
def article_texts(spark, sf):
    c = D.closed_incidents(spark, sf).select("number", F.struct(
        F.concat(F.lit("Case "), "number").alias("title"), F.col("short_description").alias("problem_summary"),
        F.array(F.struct(F.lit("look").alias("action")), F.struct(F.col("description").alias("action")))
         .alias("resolution_steps")).alias("article"))
    t = articles.article_texts(c)
    return t.select("number", F.sha2("title_text", 256).alias("title_digest"),
                    F.sha2("full_text", 256).alias("full_digest"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE,
    0.30::DOUBLE * (l_discount * 10) + 0.20::DOUBLE * least(1.0::DOUBLE, log10(l_quantity + 1) / 1.5::DOUBLE) + 0.20::DOUBLE * (l_tax * 10)
    + 0.30::DOUBLE * coalesce(CASE WHEN l_returnflag <> 'R' THEN l_discount * 5 END, 0.5::DOUBLE))), 6) AS confidence FROM lineitem""")
def confidence_score(spark, sf):
    li = D.table(spark, sf, "lineitem")
    c = scoring.confidence(F.col("l_discount") * 10, F.col("l_quantity"), F.col("l_tax") * 10,
                           F.when(F.col("l_returnflag") != "R", F.col("l_discount") * 5))
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice",
                     F.round(c, 6).alias("confidence"))


@query(f"""WITH {S.VEC}, {S.ART}, n AS (SELECT v.number, article_id, {S.cos('v.vec', 'a.vec')} AS s FROM vec v, art a
    WHERE {S.cos('v.vec', 'a.vec')} >= 0.80 QUALIFY row_number() OVER (PARTITION BY v.number ORDER BY s DESC, article_id) = 1)
  SELECT vec.number, CASE WHEN s >= 0.92 THEN 'update' WHEN s >= 0.80 THEN 'review' ELSE 'create' END AS decision, article_id
  FROM vec LEFT JOIN n USING (number)""")
def dedup_decision(spark, sf):
    v = D.team_vectors(spark, sf).select("number", "vec")
    a = D.existing_articles(spark, sf).withColumn("is_active", F.lit(True))
    n = search.nearest_article(v, a, "number")
    return n.select("number", scoring.dedup_decision(F.col("similarity")).alias("decision"), "article_id")


_STORED = """stored AS (SELECT 'sig-' || o_custkey AS cluster_signature, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS INT) AS version,
    o_orderpriority AS title FROM orders WHERE o_orderstatus = 'F'),
  inc_ AS (SELECT 'sig-' || o_custkey AS cluster_signature, o_orderpriority AS title, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn
    FROM orders WHERE o_orderstatus = 'P'),
  fresh AS (SELECT cluster_signature, CAST(coalesce(t.top, 0) + rn AS INT) AS version, title FROM inc_
    LEFT JOIN (SELECT cluster_signature, max(version) AS top FROM stored GROUP BY 1) t USING (cluster_signature))"""


@query(f"""WITH {_STORED}, both_ AS (SELECT * FROM stored UNION ALL SELECT * FROM fresh)
  SELECT *, version = max(version) OVER (PARTITION BY cluster_signature) AS is_active FROM both_""")
def versioned_upsert(spark, sf):
    """Finished orders as stored versions of their customer's article, open orders as new ones."""
    o = D.table(spark, sf, "orders").select(
        F.concat(F.lit("sig-"), "o_custkey").alias("cluster_signature"), "o_orderkey", "o_orderdate", "o_orderstatus",
        F.col("o_orderpriority").alias("title"))
    stored = ordinal(o.where(F.col("o_orderstatus") == "F"), ["cluster_signature"], ["o_orderdate", "o_orderkey"], "version")
    stored = stored.withColumn("version", F.col("version").cast("int"))
    last = stored.groupBy("cluster_signature").agg(F.max("version").alias("_m"))
    stored = stored.join(last, "cluster_signature").select(
        "cluster_signature", "version", (F.col("version") == F.col("_m")).alias("is_active"), "title")
    new = o.where(F.col("o_orderstatus") == "P").select(
        "cluster_signature", "title", F.col("o_orderkey").alias("seq"))
    return articles.versioned_upsert(stored, new)


@query(f"""SELECT event_id, c_name AS title FROM events LEFT JOIN customer ON c_custkey = user_id
  WHERE event_type = 'error' AND ts >= {S.AS_OF} - INTERVAL 20 DAY""")
def review_queue(spark, sf):
    d = D.table(spark, sf, "events").select(
        "event_id", F.col("user_id").alias("article_id"), F.col("ts").cast("timestamp").alias("created_at"),
        rules.lookup(F.col("event_type"), {"error": "review", "click": "update", "view": "create"}, "skip")
             .alias("decision"))
    a = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("article_id"), F.col("c_name").alias("title"))
    return articles.review_queue(d, a, D.ts(D.AS_OF), 20).select("event_id", "title")


_RETIRE = f"""{S.RECS}, skb AS (SELECT c_custkey AS article_id, c_acctbal > 0 AS is_active FROM customer),
  stats AS (SELECT skb.article_id, count(r.article_id) AS reco_count, avg(feedback_score) AS avg_score FROM skb LEFT JOIN recs r
    ON r.article_id = skb.article_id AND r.created_at >= CAST({S.AS_OF} AS TIMESTAMP) - INTERVAL 6 MONTH WHERE is_active GROUP BY 1)"""


@query(f"WITH {_RETIRE} SELECT article_id, reco_count, round(avg_score, 6) AS avg_score FROM stats WHERE reco_count >= 25 AND avg_score < 0.30")
def retire_articles(spark, sf):
    """At least 25 instead of 10 recommendations, which divides the test articles."""
    a = D.table(spark, sf, "customer").select(F.col("c_custkey").alias("article_id"),
                                              (F.col("c_acctbal") > 0).alias("is_active"))
    r = articles.retired_articles(a, D.recommendations(spark, sf), D.ts(D.AS_OF), min_count=25)
    return r.select("article_id", "reco_count", F.round("avg_score", 6).alias("avg_score"))


@query("""WITH w AS (SELECT date_trunc('month', DATE '1998-08-15' - to_months(CAST(i AS INT))) AS s FROM (SELECT unnest(range(1, 7)) AS i))
  SELECT strftime(s, '%Y-%m-%d') AS window_start, strftime(s + INTERVAL 1 MONTH - INTERVAL 1 DAY, '%Y-%m-%d') AS window_end,
    count(o_orderkey) AS closed FROM w LEFT JOIN orders ON date_trunc('month', o_orderdate) = s GROUP BY s""")
def month_windows(spark, sf):
    """Closed incidents per month window of the last six whole months."""
    w = articles.month_windows(spark, "1998-08-15", 6)
    o = D.table(spark, sf, "orders").where(
        (F.col("o_orderdate") >= F.lit("1998-02-01").cast("timestamp_ntz"))
        & (F.col("o_orderdate") < F.lit("1998-08-01").cast("timestamp_ntz")))
    per = o.groupBy(F.trunc(F.to_date("o_orderdate"), "MM").alias("window_start")).agg(F.count("*").alias("closed"))
    day = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)                         # noqa: E731
    return w.join(per, "window_start", "left").select(
        day("window_start"), day("window_end"), F.coalesce("closed", F.lit(0)).alias("closed"))


@query(f"""WITH {S.RECS}, f AS (SELECT article_id, avg(feedback_score) AS feedback FROM recs GROUP BY 1)
  SELECT c_custkey AS article_id, round(0.30::DOUBLE * 0.8 + 0.20::DOUBLE * least(1.0::DOUBLE, log10(c_nationkey + 2.0::DOUBLE) / 1.5) + 0.20::DOUBLE * 0.7
    + 0.30::DOUBLE * coalesce(feedback, 0.5), 6) AS confidence FROM customer LEFT JOIN f ON f.article_id = c_custkey""")
def confidence_refresh(spark, sf):
    a = D.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("article_id"), F.lit(0.8).alias("cohesion"), (F.col("c_nationkey") + 1).alias("members"),
        F.lit(0.7).alias("self_rating"))
    c = articles.confidence_refresh(a, D.recommendations(spark, sf))
    return c.select("article_id", F.round("confidence", 6).alias("confidence"))


@query(f"""WITH {S.VEC}, {S.ART}, {S.RUNS}, {S.RECS}, m AS (SELECT DISTINCT vec_id FROM vec v, art a WHERE is_active
    AND {S.cos('v.vec', 'a.vec')} >= 0.93),
  j AS (SELECT m.vec_id IS NOT NULL AS hit, duration_ms FROM runs LEFT JOIN m ON m.vec_id = run_id)
  SELECT count(*) AS incidents, count(*) FILTER (hit) AS matched, round(count(*) FILTER (hit) / count(*), 6) AS share,
    round(avg(duration_ms) FILTER (hit), 3) AS ms_with, round(avg(duration_ms) FILTER (NOT hit), 3) AS ms_without,
    (SELECT count(*) FROM art WHERE is_active) AS active_articles, (SELECT round(avg(feedback_score), 6) FROM recs) AS mean_feedback FROM j""")
def kb_impact(spark, sf):
    v = D.team_vectors(spark, sf).select(F.col("vec_id").alias("run_id"), "vec")
    a = D.existing_articles(spark, sf)
    hits = search.vector_topk(v, a.where("is_active"), "run_id", "article_id", k=3, min_score=0.93)
    runs = D.runs(spark, sf).select("run_id", "duration_ms")
    return articles.kb_impact(runs.select("run_id"), hits, runs, a, D.recommendations(spark, sf), "run_id")


@query(f"WITH {S.ART} SELECT article_id FROM art WHERE is_active AND label % 2 = 0")
def unpublished_articles(spark, sf):
    a = D.existing_articles(spark, sf).withColumn(
        "page_id", F.when(F.col("label") % 2 == 1, F.concat(F.lit("p-"), "label")))
    return articles.unpublished(a).select("article_id")


@query(f"WITH {S.ART} SELECT article_id FROM art WHERE label % 3 <> 0")
def stale_vectors(spark, sf):
    """Articles whose vectors stem from another model version (or from none)."""
    a = D.existing_articles(spark, sf).withColumn(
        "embedding_model_version", rules.lookup((F.col("label") % 3).cast("int"), {0: "v2", 1: "v1"}))
    return search.stale_vectors(a, "v2").select("article_id")


def _esc(c: str) -> str:
    for a, b in [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("''", "&#x27;")]:
        c = f"replace({c}, '{a}', '{b}')"
    return c


@query(f"""SELECT doc_id, '[AUTO] Doc <' || doc_id || '> & "' || lang || '"' AS page_title, sha256('<h1>' || {_esc("""'Doc <' || doc_id || '> & "' || lang || '"'""")}
  || '</h1><h2>Problem summary</h2><p>' || {_esc('split_part(text, chr(10), 1)')} || '</p>'
  || CASE WHEN lang <> 'en' THEN '<h2>Root cause</h2><p>' || {_esc("source || ''' is down'")} || '</p>' ELSE '' END
  || '<h2>Resolution steps</h2><ol>' || array_to_string(list_transform(string_split(text, chr(10)), lambda s, i: '<li>' || {_esc('s')}
     || CASE WHEN i = 1 THEN '<br/><code>' || {_esc("'run <a> & b'")} || '</code>' ELSE '' END || '</li>'), '')
  || '</ol><h2>Keywords</h2><p>' || lang || ', ' || source || '</p><hr/><p><em>Auto-synthesized from 2 incidents: INC' || doc_id || ', INC&lt;x&gt;</em></p>') AS digest
  FROM documents""")
def article_markup(spark, sf):
    d = D.table(spark, sf, "documents")
    steps = F.transform(F.split("text", "\n"), lambda s, i: F.struct(
        (i + 1).alias("step"), s.alias("action"), F.when(i == 0, "run <a> & b").alias("command")))
    a = d.select("doc_id", F.array(F.concat(F.lit("INC"), "doc_id"), F.lit("INC<x>")).alias("source_incident_ids"),
                 F.struct(F.concat(F.lit("Doc <"), "doc_id", F.lit('> & "'), "lang", F.lit('"')).alias("title"),
                          F.get(F.split("text", "\n"), F.lit(0)).alias("problem_summary"),
                          F.when(F.col("lang") != "en", F.concat("source", F.lit("' is down"))).alias("root_cause"),
                          steps.alias("resolution_steps"), F.array("lang", "source").alias("keywords")).alias("article"))
    m = articles.article_markup(a, key="doc_id")
    return m.select("doc_id", "page_title", F.sha2("body", 256).alias("digest"))


# ---- root cause ------------------------------------------------------------------

@query(f"""WITH {ANALYSED}, h AS (SELECT user_id AS k, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events),
  kb AS (SELECT k, string_agg('- page ' || event_id || ' (' || printf('%.2f', value) || '): seen', chr(10) ORDER BY rn) AS kb_text FROM h WHERE rn <= 3 GROUP BY 1)
  SELECT external_id, 'Title: Ticket ' || external_id || chr(10) || 'Severity: ' || severity || chr(10) || 'Source: servicenow' || chr(10)
   || 'Errors: ' || errors || ', Warns: ' || warnings || chr(10) || 'Classification: ' || classification || chr(10)
   || 'Summary: Found ' || errors || ' errors and ' || warnings || ' warnings over last '
   || CASE severity WHEN 'P1' THEN 15 WHEN 'P2' THEN 30 WHEN 'P3' THEN 30 ELSE 60 END || 'min.' || chr(10)
   || coalesce(kb_text, 'No KB matches.') || chr(10) || 'INC: ' || CASE WHEN o_orderstatus = 'F' THEN 'T' || incident_key ELSE 'N/A' END AS context
  FROM ana LEFT JOIN kb ON k = incident_key JOIN orders ON o_orderkey = incident_key""")
def rca_context(spark, sf):
    inc = D.incident_core(spark, sf)
    logs = loganalysis.analyse_logs(inc, D.logs(spark, sf)).select(
        "external_id", "errors", "warnings", "classification", "summary")
    from triagelake.operators.keyed import top_per_key
    ev = D.table(spark, sf, "events").select(
        D.ticket_no(F.col("user_id")).alias("external_id"), "event_id", F.col("value").alias("score"),
        F.concat(F.lit("page "), "event_id").alias("title"), F.lit("seen").alias("excerpt"))
    hits = top_per_key(ev, ["external_id"], [F.col("score").desc(), F.col("event_id")], 3)
    tick = D.table(spark, sf, "orders").where(F.col("o_orderstatus") == "F").select(
        D.ticket_no(F.col("o_orderkey")).alias("external_id"), F.concat(F.lit("T"), "o_orderkey").alias("ticket_id"))
    events = inc.select("external_id", "severity", F.lit("servicenow").alias("source"),
                        F.concat(F.lit("Ticket "), "external_id").alias("title"))
    return rootcause.context(events, logs, rootcause.kb_lines(hits, "external_id"), tick, "external_id")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'Unable to determine root cause automatically.' ELSE o_orderpriority END AS root_cause,
  CASE WHEN o_orderstatus = 'O' THEN 'unknown' WHEN o_orderstatus = 'F' THEN 'memory' END AS root_cause_category,
  CASE o_orderstatus WHEN 'O' THEN 0.3::DOUBLE WHEN 'F' THEN (o_orderkey % 12) / 10.0::DOUBLE ELSE 0.5::DOUBLE END AS confidence,
  o_orderstatus = 'F' AS rollback_required, CASE o_orderstatus WHEN 'F' THEN '1:check;7:fix' WHEN 'P' THEN '1:plain text' ELSE '' END AS steps
  FROM orders""")
def rca_parse(spark, sf):
    """Finished orders answer in full, open ones without optional fields, the rest with bad text."""
    o = D.table(spark, sf, "orders")
    full = F.concat(F.lit('{"root_cause":"'), "o_orderpriority", F.lit('","root_cause_category":"memory","confidence":'),
                    (F.col("o_orderkey") % 12) / 10.0,
                    F.lit(',"rollback_required":true,"resolution_steps":[{"step_num":1,"action":"check"},{"step_num":7,"action":"fix"}]}'))
    part = F.concat(F.lit('{"root_cause":"'), "o_orderpriority", F.lit('","resolution_steps":["plain text"]}'))
    raw = o.select("o_orderkey", F.when(F.col("o_orderstatus") == "F", full)
                   .when(F.col("o_orderstatus") == "P", part).otherwise("Sorry, no JSON").alias("value"))
    r = rootcause.parse_results(raw)
    flat = F.transform("steps", lambda s: F.concat(s["step_num"].cast("string"), F.lit(":"), s["action"]))
    return r.select("o_orderkey", "root_cause", "root_cause_category", "confidence", "rollback_required",
                    F.array_join(flat, ";").alias("steps"))


@query("""SELECT problem, count(*) AS n FROM (SELECT CASE WHEN NOT l_quantity / 45.0 BETWEEN 0 AND 1 THEN 'confidence'
  WHEN l_linenumber > 5 THEN 'severity' WHEN l_linestatus = 'O' THEN 'flow' END AS problem FROM lineitem) GROUP BY 1""")
def rca_validation(spark, sf):
    li = D.table(spark, sf, "lineitem")
    p = rootcause.result_problem(
        F.col("l_quantity") / 45.0, F.concat(F.lit("P"), "l_linenumber"),
        F.when(F.col("l_linestatus") == "F", "primary").otherwise("tertiary"))
    return li.groupBy(p.alias("problem")).agg(F.count("*").alias("n"))


@query("SELECT pct, count(*) AS n FROM (SELECT CAST(trunc(l_discount * 7.77::DOUBLE * 100) AS INT) AS pct FROM lineitem) GROUP BY 1")
def confidence_pct(spark, sf):
    li = D.table(spark, sf, "lineitem")
    return li.groupBy(rules.percent_truncated(F.col("l_discount") * 7.77).alias("pct")).agg(F.count("*").alias("n"))


# ---- audits ---------------------------------------------------------------------

@query(f"""WITH {S.RUNS}, {S.INC}, {S.STEPS}, {RES} SELECT * FROM (VALUES ('incidents','allowed:severity'), ('incidents','allowed:flow')) v(table_name, rule), (SELECT 0 AS violations)
  UNION ALL SELECT 'pipeline_runs', 'allowed:status', count(*) FILTER (o_orderstatus NOT IN ('F','P')) FROM orders
  UNION ALL SELECT 'pipeline_runs', 'allowed:flow', 0 UNION ALL SELECT 'pipeline_steps', 'allowed:status', 0
  UNION ALL SELECT 'pipeline_steps', 'range:agent_num', count(*) FILTER (l_linenumber + 1 > 7) FROM lineitem
  UNION ALL SELECT 'resolutions', 'range:confidence', count(*) FILTER (NOT confidence BETWEEN 0 AND 100) FROM res
  UNION ALL SELECT 'ratings', 'range:rating', count(*) FILTER (NOT rating BETWEEN 1 AND 5) FROM res
  UNION ALL SELECT 'messages', 'allowed:role', 0
  UNION ALL SELECT 'incidents', 'unique:external_id', 0
  UNION ALL SELECT 'pipeline_steps', 'unique:run_id,agent_num', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
  UNION ALL SELECT 'documents', 'unique:content_hash', count(*) FROM (SELECT 1 FROM documents GROUP BY text HAVING count(*) > 1)
  UNION ALL SELECT 'pipeline_runs', 'foreign:incident_id', count(*) FROM orders WHERE o_orderstatus = 'O'
  UNION ALL SELECT 'pipeline_steps', 'foreign:run_id', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)""")
def constraint_audit(spark, sf):
    """Failed runs carry a status outside the list and lose their incident, so rules do fire."""
    runs = D.runs(spark, sf)
    failed = F.col("status") == "failed"
    res = D.resolutions(spark, sf)
    return audit.constraint_audit({
        "incidents": D.incident_core(spark, sf).select("external_id", "severity", "flow"),
        "pipeline_runs": runs.select(
            F.col("run_id").alias("id"), F.when(failed, "broken").otherwise(F.col("status")).alias("status"), "flow",
            F.when(failed, F.lit("gone")).otherwise(F.col("external_id")).alias("incident_id")),
        "pipeline_steps": D.step_log(spark, sf).select("run_id", "agent_num", "status").withColumn(
            "agent_num", F.col("agent_num") + 1),
        "resolutions": res.select("confidence"), "ratings": res.select("rating"),
        "messages": D.conversations(spark, sf).select("role"),
        "documents": D.table(spark, sf, "documents").select(F.sha2("text", 256).alias("content_hash"))})


@query("""SELECT 'entity-' || c_custkey AS name, c_custkey IN (SELECT s_suppkey FROM supplier) AS found FROM customer""")
def cmdb_gap(spark, sf):
    svc = D.table(spark, sf, "customer").select(F.concat(F.lit("entity-"), "c_custkey").alias("name"))
    items = D.table(spark, sf, "supplier").select(F.concat(F.lit("entity-"), "s_suppkey").alias("name"))
    return audit.cmdb_gap(svc, items)


@query("""SELECT count(*) FILTER (s_suppkey IS NOT NULL) AS found, count(*) FILTER (s_suppkey IS NULL) AS missing
  FROM customer LEFT JOIN supplier ON s_suppkey = c_custkey""")
def cmdb_gap_counts(spark, sf):
    return audit.gap_counts(cmdb_gap(spark, sf))


# ---- triage report ------------------------------------------------------------------

_TRIAGE_NOTE = """'[Auto-Triage]' || chr(10) || 'Logs: ' || errors || ' errors / ' || warnings || ' warns in last '
  || CASE severity WHEN 'P1' THEN 15 WHEN 'P2' THEN 30 WHEN 'P3' THEN 30 ELSE 60 END || 'min.' || chr(10) || 'Classification: ' || classification || chr(10)
  || 'Summary: Found ' || errors || ' errors and ' || warnings || ' warnings over last '
  || CASE severity WHEN 'P1' THEN 15 WHEN 'P2' THEN 30 WHEN 'P3' THEN 30 ELSE 60 END || 'min.'"""


@query(f"""WITH {ANALYSED}, {RES}, {S.VEC}, {S.ART}, near AS (SELECT vec_id, article_id, round({S.cos('v.vec', 'a.vec')}, 4) AS score FROM vec v, art a
    WHERE {S.cos('v.vec', 'a.vec')} >= 0.60 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY {S.cos('v.vec', 'a.vec')} DESC, article_id) = 1)
  SELECT external_id, scanned, errors, warnings, classification, article_id AS best_article, score AS best_score, root_cause_cat,
    CAST(trunc(confidence / 111.0::DOUBLE * 100) AS INT) AS confidence_pct, coalesce(confidence > 80, false) AS rollback_required,
    'check ' || coalesce(root_cause_cat, 'unknown') || ';apply fix;verify;notify;close' AS first_steps, sha256({_TRIAGE_NOTE}) AS note_digest
  FROM ana LEFT JOIN res ON run_id = incident_key LEFT JOIN near ON vec_id = incident_key""")
def triage_report(spark, sf):
    inc = D.incident_core(spark, sf)
    logs = loganalysis.analyse_logs(inc, D.logs(spark, sf))
    v = D.team_vectors(spark, sf).select(F.col("vec_id").alias("incident_key"), "vec")
    best = search.vector_topk(v, D.existing_articles(spark, sf), "incident_key", "article_id", k=1)
    res = D.resolutions(spark, sf).select(F.col("run_id").alias("incident_key"), "root_cause_cat", "confidence")
    j = (logs.join(res, "incident_key", "left")
             .join(best.select("incident_key", F.col("article_id").alias("best_article"),
                               F.col("score").alias("best_score")), "incident_key", "left"))
    steps = F.array(F.concat(F.lit("check "), F.coalesce("root_cause_cat", F.lit("unknown"))), F.lit("apply fix"),
                    F.lit("verify"), F.lit("notify"), F.lit("close"), F.lit("file a report"))
    note = rootcause.triage_note(F.col("errors"), F.col("warnings"), rules.log_window_minutes(F.col("severity")),
                                 F.col("classification"), F.col("summary"))
    return j.select(
        "external_id", "scanned", "errors", "warnings", "classification", "best_article", "best_score", "root_cause_cat",
        rules.percent_truncated(F.col("confidence") / 111.0).alias("confidence_pct"),
        F.coalesce(F.col("confidence") > 80, F.lit(False)).alias("rollback_required"),
        F.array_join(F.slice(steps, 1, 5), ";").alias("first_steps"), F.sha2(note, 256).alias("note_digest"))


@query(f"""WITH {S.INC} SELECT external_id, '[Final RCA]' || chr(10) || 'Root cause: ' || coalesce(service, 'none') || chr(10)
  || 'Category: ' || flow || chr(10) || 'Confidence: ' || CAST(round_even((incident_key % 101) / 100.0::DOUBLE * 100, 0) AS INT) || '%' || chr(10)
  || 'Rollback required: ' || CASE WHEN incident_key % 2 = 0 THEN 'YES — target: ' || CASE WHEN incident_key % 3 = 0 THEN 'latest' ELSE 'v' || incident_key END
    ELSE 'No' END || chr(10) || chr(10) || 'Resolution steps:' || chr(10)
  || array_to_string(list_transform(range(1, least(incident_key % 8, 5) + 1), lambda i: i || '. step ' || i), chr(10)) AS note FROM inc""")
def rca_final_note(spark, sf):
    """The closing note; incidents have 0 to 7 steps, of which five are shown."""
    i = D.incidents(spark, sf)
    k = F.col("incident_key")
    steps = F.transform(F.when(k % 8 > 0, F.sequence(F.lit(1).cast("bigint"), k % 8)).otherwise(F.array().cast("array<bigint>")),
                        lambda n: F.concat(F.lit("step "), n.cast("string")))
    note = rootcause.final_note(F.coalesce("service", F.lit("none")), F.col("flow"), (k % 101) / F.lit(100.0), k % 2 == 0,
                                F.when(k % 3 != 0, F.concat(F.lit("v"), k.cast("string"))), steps)
    return i.select("external_id", note.alias("note"))
