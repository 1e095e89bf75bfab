"""Inputs that tell a right answer from an earlier, simpler one."""

import datetime as dt
import random
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from triagelake.functions import text
from triagelake.operators import articles, documents, intervals, loganalysis, rootcause
from triagelake.sources import readers

T0 = dt.datetime(2024, 1, 15, 12, 0, 30)


class Plain(HTMLParser):
    def __init__(self):
        super().__init__()
        self.out = ""

    def handle_data(self, data):
        self.out += data


def parsed(t):
    p = Plain()
    p.feed(t or "")
    p.close()
    return p.out


def test_markup_as_an_html_parser(spark):
    cases = ['a&rsquo;b &#8211; c &eacute; <a title="x>y">z</a>', '<script>var t="</p>";</script>k &copy;', "1 < 2 & 3",
             "<b>open", "tail <a hre", "x &amp;lt; y", "<!-- c --><style>p{}</style>q", None, "", "plain"]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, c string")
    got = {r.i: r.o for r in df.select("i", text.strip_markup(F.col("c")).alias("o")).collect()}
    assert got == {i: parsed(c) for i, c in enumerate(cases)}


def test_markup_of_all_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("html")
    rows = pages.select("html", text.strip_markup(F.col("html")).alias("o")).collect()
    assert rows and all(r.o == parsed(r.html) for r in rows)


def test_stored_row_keeps_its_content(spark):
    log = spark.createDataFrame([("kb", "9", "same", 1), ("kb", "1", "same", 2)],
                                "source_type string, source_id string, content string, seq int")
    stored, rejected = documents.document_upsert(log, ["seq"])
    assert [r.source_id for r in stored.collect()] == ["9"]
    assert [(r.source_id, r.kept_source_id) for r in rejected.collect()] == [("1", "9")]


def test_retire_bound_is_an_instant(spark):
    a = spark.createDataFrame([("a", True)], "article_id string, is_active boolean")
    r = spark.createDataFrame([("a", dt.datetime(2023, 7, 15, 12, 0, 29), 0.1), ("a", T0, 0.2)],
                              "article_id string, created_at timestamp, feedback_score double")
    got = articles.retire_stats(a, r, F.lit("2024-01-15 12:00:30").cast("timestamp")).first()
    assert got.reco_count == 1


@pytest.mark.parametrize("more, bad", [
    ("", ""), (',"keywords":null', "keywords"), (',"resolution_steps":[{"step":1,"action":"x","who":"y"}]', "extra_fields")])
def test_article_forbids_nested_extras_and_null_keywords(spark, more, bad):
    steps = "" if "resolution_steps" in more else ',"resolution_steps":[{"step":1,"action":"x"}]'
    j = ('{"title":"A long title","problem_summary":"A summary of twenty letters","assignment_group":"g",'
         '"confidence_self_rating":0.5' + steps + more + "}")
    v = articles.validate_articles(spark.createDataFrame([(j,)], "article_json string")).first()
    assert ",".join(v.problems) == bad


def test_confidence_as_text(spark):
    raw = spark.createDataFrame([('{"confidence":"0.8"}',), ('{"confidence":0.7}',), ('{"confidence":"x"}',)], "value string")
    assert [r.confidence for r in rootcause.parse_results(raw).collect()] == [0.8, 0.7, 0.5]


def test_poll_keeps_all_unseen(spark):
    pair = "struct<value:string,display_value:string>"
    rows = [(f"N{i}", T0 - dt.timedelta(seconds=i), None, None, None, None, None) for i in range(60)]
    rec = spark.createDataFrame(rows, f"number string, created_at timestamp, priority {pair}, short_description string, "
                                      f"caller_id {pair}, cmdb_ci {pair}, state {pair}")
    seen = spark.createDataFrame([("N3",)], "number string")
    got = readers.poll_recent(rec, F.lit(str(T0)).cast("timestamp"), seen=seen)
    assert {r.number for r in got.collect()} == {f"N{i}" for i in range(60)} - {"N3"}


def test_top_messages_against_pairs(spark, monkeypatch):
    monkeypatch.setattr(intervals, "PART_ROWS", 50)
    monkeypatch.setattr(intervals, "PART_WINDOWS", 10)
    rnd = random.Random(5)
    logs = [(T0 + dt.timedelta(seconds=rnd.randint(0, 9000)), rnd.choice("ab"), f"m{rnd.randint(0, 12)}") for _ in range(600)]
    wins = [(f"w{i}", rnd.choice("abc"), T0 + dt.timedelta(seconds=rnd.randint(0, 8000)), rnd.choice([60, 900, 3600]))
            for i in range(60)]
    ldf = spark.createDataFrame(logs, "ts timestamp, entity string, content string")
    wdf = spark.createDataFrame([(i, e, t - dt.timedelta(seconds=s), t) for i, e, t, s in wins],
                                "id string, entity string, lo timestamp, hi timestamp")
    got = {(r.id, r.content, r.n) for r in intervals.top_in_window(ldf, wdf, "entity", "content", "id", 4).collect()}
    want = set()
    for i, e, t, s in wins:
        n = {}
        for lt, le, m in logs:
            if le == e and t - dt.timedelta(seconds=s) <= lt <= t:
                n[m] = n.get(m, 0) + 1
        want |= {(i, m, c) for m, c in sorted(n.items(), key=lambda x: (-x[1], x[0]))[:4]}
    assert got == want


def test_many_messages_make_no_pairs(spark):
    """400 incidents and 8,000 distinct messages: nothing as large as their product."""
    inc = spark.range(400).selectExpr("concat('I', id) AS external_id", "'h' AS entity", "'P1' AS severity",
                                      "timestamp_seconds(1705320000 + id) AS opened_at")
    logs = spark.range(8000).selectExpr("id AS event_id", "timestamp_seconds(1705319700 + id % 300) AS ts", "'h' AS entity",
                                        "'ERROR' AS level", "concat('message ', id) AS content")
    top = loganalysis.top_messages(inc, logs)
    assert top.count() == 400
    counts = loganalysis.incident_log_counts(inc, logs)
    assert counts.columns == ["external_id", "level", "n"] and counts.count() <= 400
