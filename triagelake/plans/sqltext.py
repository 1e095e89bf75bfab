"""SQL twins of the domain mapping (sources/domain.py) as reusable table expressions."""

from triagelake.functions.text import SCRUB_RULES

AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"


def case(expr: str, table: dict, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN {k!r} THEN {v!r}" for k, v in table.items())
    return f"CASE {expr} {arms} ELSE {default} END"


def fmt(ts: str) -> str:
    return f"strftime({ts}, '%Y-%m-%d %H:%M:%S')"


OPENED = "TIMESTAMP '2024-01-01' + to_minutes((o_orderkey * 173) % 43200)"
FLOW = "CASE WHEN left(o_orderpriority,1) IN ('1','2','3') THEN 'primary' ELSE 'secondary' END"

INC = f"""inc AS (SELECT o_orderkey AS incident_key, printf('INC%07d', o_orderkey) AS external_id,
  left(o_orderpriority,1) AS priority, 'P' || left(o_orderpriority,1) AS severity, {FLOW} AS flow,
  {OPENED} AS opened_at, o_custkey % 150 AS entity, c_mktsegment AS service, n_name AS team
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN nation ON c_nationkey = n_nationkey)"""

RUNS = f"""runs AS (SELECT o_orderkey AS run_id, printf('INC%07d', o_orderkey) AS external_id,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'running' ELSE 'failed' END AS status,
  {FLOW} AS flow, {OPENED} AS started_at,
  CASE WHEN o_orderstatus = 'F' THEN {OPENED} + to_milliseconds(CAST(floor(o_totalprice/10) AS BIGINT)) END AS completed_at,
  CAST(floor(o_totalprice/10) AS BIGINT) AS duration_ms FROM orders)"""

STEPS = """steplog AS (SELECT l_orderkey AS run_id, l_linenumber AS agent_num,
  CASE l_returnflag WHEN 'A' THEN 'completed' WHEN 'N' THEN 'running' ELSE 'failed' END AS status,
  CAST(l_quantity*1000 AS BIGINT) AS duration_ms, l_shipdate, l_partkey, l_suppkey, l_extendedprice FROM lineitem),
steps AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id, agent_num
  ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC) AS rn FROM steplog) WHERE rn = 1)"""

K = "CAST(json_extract_string(props, '$.k') AS INT)"

LOGS = f"""logs AS (SELECT event_id, ts, user_id AS entity,
  CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'purchase' THEN 'WARN' WHEN 'signup' THEN 'SEVERE' ELSE 'INFO' END AS level,
  CASE {K} % 5 WHEN 0 THEN 'connection timeout' WHEN 1 THEN 'heap oom' WHEN 2 THEN 'deploy failed'
    WHEN 3 THEN 'slow request' ELSE 'ok' END AS content FROM events)"""

REVENTS = f"""rev AS (SELECT event_id, ts, user_id AS run_id, value,
  CASE event_type WHEN 'view' THEN 'agent_start' WHEN 'click' THEN 'agent_done' WHEN 'error' THEN 'agent_error'
    WHEN 'purchase' THEN 'pipeline_complete' ELSE 'pipeline_started' END AS event,
  {K} % 7 + 1 AS agent_num FROM events)"""

PROBLEMS = f"""prob AS (SELECT event_id, ts, user_id, 'PRB-' || user_id AS problem_id,
  CASE WHEN {K} % 10 = 9 THEN 'custom' WHEN {K} % 10 = 8 THEN 'info' ELSE
    CASE event_type WHEN 'error' THEN 'error' WHEN 'click' THEN 'Performance' WHEN 'view' THEN 'AVAILABILITY'
      WHEN 'purchase' THEN 'resource' WHEN 'signup' THEN 'weird' ELSE 'INFO' END END AS kind,
  CASE WHEN {K} % 4 = 0 THEN 'Resolved' ELSE 'OPEN' END AS status, 'host-' || (user_id % 20) AS host,
  CASE WHEN {K} % 3 = 0 THEN 'svc-' || ({K} % 6) END AS service FROM events)"""

EVENT_SEV = """CASE upper(kind) WHEN 'AVAILABILITY' THEN 'P1' WHEN 'PERFORMANCE' THEN 'P2' WHEN 'ERROR' THEN 'P3'
  WHEN 'RESOURCE' THEN 'P3' WHEN 'CUSTOM' THEN 'P4' ELSE 'P5' END"""

CLOSED = r"""closed AS (SELECT printf('INC%07d', d.doc_id) AS number, d.doc_id,
  split_part(text, chr(10), 1) AS short_description, 'reported in ' || lang AS description,
  (CASE WHEN d.doc_id % 5 = 0 THEN '<p>' ELSE '' END) || text
   || (CASE WHEN d.doc_id % 3 = 0 THEN chr(10) || 'step 1: restart the service' ELSE '' END)
   || (CASE WHEN d.doc_id % 4 = 0 THEN printf(' MRN-%08d', d.doc_id) ELSE '' END)
   || (CASE WHEN d.doc_id % 5 = 0 THEN '</p>' ELSE '' END) AS close_notes,
  CASE WHEN d.doc_id % 7 = 0 THEN 'Duplicate' WHEN d.doc_id % 7 = 1 THEN 'User Error - No Action'
   WHEN quality = 1 THEN 'Solved (Permanently)' WHEN quality = 0 THEN 'Solved (Workaround)' END AS close_code,
  ' ' || source AS assignment_group, CASE WHEN d.doc_id % 3 = 1 THEN '' ELSE lang END AS category,
  TIMESTAMP '2024-01-01' + to_minutes((d.doc_id * 97) % 43200) AS closed_ts, d.doc_id % 50 = 7 AS bad_time
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def strip_markup(c: str) -> str:
    out = f"regexp_replace(coalesce({c}, ''), '(?s)<!--.*?-->', '', 'g')"
    out = f"regexp_replace({out}, '<[!/?]?[A-Za-z][^>]*>', '', 'g')"
    for ref, char in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&#x27;", "''"),
                      ("&nbsp;", " "), ("&amp;", "&")]:
        out = f"replace({out}, '{ref}', '{char}')"
    return out


def strip_edges(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def collapse(c: str) -> str:
    out = rf"regexp_replace({c}, '[ \t\f\x0B]+', ' ', 'g')"
    return strip_edges(rf"regexp_replace({out}, '\n{{2,}}', chr(10), 'g')")


def words(c: str) -> str:
    return rf"list_filter(regexp_split_to_array({c}, '\s+'), lambda w: w <> '')"


def scrub(c: str) -> str:
    for p, m in SCRUB_RULES:
        c = f"regexp_replace({c}, '{p}', '{m}', 'gi')"
    return c


def markers(c: str) -> str:
    """Redactions made: markers in the scrubbed text (the source texts hold none)."""
    return f"CAST(len(regexp_extract_all({scrub(c)}, 'REDACTED')) AS INT)"


QUALITY = r"""least(round(
  CASE WHEN n_words >= 50 OR length(close_notes) >= 200 THEN 0.30::DOUBLE WHEN n_words >= 20 OR length(close_notes) >= 80 THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN regexp_matches(close_notes, '(?im)(^\s*(?:step\s*\d+|first|then|finally|\d+[\.\)])\b)') THEN 0.20::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN close_code = 'Solved (Permanently)' THEN 0.20::DOUBLE WHEN starts_with(close_code, 'Solved') THEN 0.10::DOUBLE ELSE 0.0::DOUBLE END, 10), 1.0)"""

NORMALIZED = f"""{CLOSED}, norm0 AS (SELECT number, doc_id,
  {collapse(strip_markup('short_description'))} AS short_description,
  {collapse(strip_markup('description'))} AS description,
  {collapse(strip_markup('close_notes'))} AS close_notes,
  {strip_edges("coalesce(close_code, '')")} AS close_code, {strip_edges('assignment_group')} AS assignment_group,
  nullif(category, '') AS category, closed_ts FROM closed
  WHERE coalesce(trim(close_code), '') NOT IN ('Cannot Reproduce','Duplicate','User Error - No Action') AND NOT bad_time),
norm AS (SELECT * FROM norm0 WHERE close_notes <> '')"""

SCORED = f"""{NORMALIZED}, scrubbed AS (SELECT * REPLACE ({scrub('close_notes')} AS close_notes,
  {scrub('short_description')} AS short_description), {markers('close_notes')} + {markers('short_description')}
  + {markers('description')} AS redactions FROM norm),
scored AS (SELECT *, {QUALITY} AS quality FROM (SELECT *, len({words('close_notes')}) AS n_words FROM scrubbed))"""


def planted(strength: str = "0.3") -> str:
    return (f"list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: {strength} * x "
            f"+ CASE WHEN i - 1 = label THEN 1.0 ELSE 0.0 END)")


VEC = f"""vec AS (SELECT printf('N%06d', vec_id) AS number, 'team' || label AS team, vec_id, label,
  {planted()} AS vec FROM embeddings)"""

ART = f"""art AS (SELECT 'art-' || label AS article_id, 'sig-' || label AS cluster_signature, label,
  label % 4 <> 3 AS is_active, 'team' || label AS team, 'cat' || (label % 4) AS category,
  round(label / 9.0, 6) AS confidence,
  {planted("(CASE label % 3 WHEN 0 THEN 0.2 WHEN 1 THEN 0.5 ELSE 1.0 END)")} AS vec
  FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY vec_id) = 1)"""

RECS = """recs AS (SELECT event_id, user_id AS article_id,
  CASE WHEN user_id % 25 <> 24 THEN least(value/100, 1.0) * (user_id % 50) / 50 END AS feedback_score, ts AS created_at
  FROM events WHERE event_type IN ('click','purchase'))"""


def cos(a: str, b: str) -> str:
    return f"round(list_cosine_similarity({a}, {b}), 12)"


def chunk_rows(src: str, keys: str, content: str, size: int = 400, overlap: int = 50) -> str:
    """(keys, chunk_index, chunk, token_count) of a table with a word list `w`."""
    step = size - overlap
    return f"""SELECT {keys}, CAST(i AS INT) AS chunk_index,
  CASE WHEN len(w) <= {size} THEN {content} ELSE array_to_string(list_slice(w, i*{step}+1, i*{step}+{size}), ' ') END AS chunk,
  CAST(CASE WHEN len(w) <= {size} THEN len(w) ELSE len(list_slice(w, i*{step}+1, i*{step}+{size})) END AS INT) AS token_count
  FROM (SELECT *, unnest(range(0, CASE WHEN len(w) <= {size} THEN 1 ELSE CAST(ceil((len(w)-{size})/{step}.0) AS BIGINT)+1 END)) AS i FROM {src})"""
