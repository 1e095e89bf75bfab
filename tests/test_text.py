"""Cleaning, scrubbing, scoring and chunk rules on hand-written rows."""

import pytest
from pyspark.sql import functions as F

from triagelake.functions import rules, scoring, text
from triagelake.operators import cleaning, documents


def values(spark, texts, expr):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t"))).collect()]


def test_markup_edges(spark):
    got = values(spark, ["Q&A", "a <b", "x < 5 y", "a &amp; b", "<p>a<br/>b</p>", "a<!-- x > y -->b",
                         "<script>var x</script>", None], text.strip_markup)
    assert got == ["Q&A", "a <b", "x < 5 y", "a & b", "ab", "ab", "var x", ""]


def test_collapse_whitespace(spark):
    assert values(spark, ["  a \t b\n\n\nc  ", " x "], text.collapse_whitespace) == ["a b\nc", "x"]


@pytest.mark.parametrize("sample,marker", [
    ("MRN 12345678", "[MRN REDACTED]"), ("DOB 01/02/1980", "[DOB REDACTED]"), ("NPI:1234567890", "[NPI REDACTED]"),
    ("ICD-10 E11.9", "[DIAGNOSIS-CODE REDACTED]"), ("patient id:A123", "[PATIENT-ID REDACTED]"),
    ("ssn 123-45-6789", "[ID REDACTED]"), ("member number 1234567", "[PATIENT-ID REDACTED]")])
def test_scrub_samples(spark, sample, marker):
    df = spark.createDataFrame([(f"see {sample} now",)], "t string")
    out, n = df.select(text.scrub(F.col("t")), text.scrub_count(F.col("t"))).first()
    assert marker in out and n == 1


def test_scrub_matches_python(spark):
    import re
    samples = ["MRN 1234 and MRN-99999999", "patient idle", "ünïMRN 1234", "mrn:123456789012 x", "pt id 5 member id 77",
               "no ids here", "ICD-11: a1.2b", "[MRN REDACTED] MRN 1234", "patient name 1234567", "ſsn 123-45-6789",
               "patıent id 5", "", "MEMBER ID: 123456 patient x 123456"]
    want = []
    for s in samples:
        n = 0
        for p, m in text.SCRUB_RULES:
            s, k = re.subn(p, m, s, flags=re.IGNORECASE)
            n += k
        want.append((s, n))
    df = spark.createDataFrame([(i, s) for i, s in enumerate(samples)], "i int, t string")
    got = [tuple(r) for r in df.orderBy("i").select(text.scrub(F.col("t")), text.scrub_count(F.col("t"))).collect()]
    assert got == want
    again = spark.createDataFrame([(g,) for g, _ in got], "t string").select(text.scrub(F.col("t"))).collect()
    assert [r[0] for r in again] == [g for g, _ in got]          # scrubbing is idempotent


def test_quality_score(spark):
    rows = [("word " * 60 + "\nstep 1: restart", "Solved (Permanently)", 0.70), ("short", "Solved (Workaround)", 0.10),
            ("w " * 25, None, 0.15), ("1.do this", "x", 0.20), ("1. do this", "x", 0.0), ("", "Solved", 0.10)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, n string, c string, want double")
    for r in df.select("want", text.quality_score(F.col("n"), F.col("c")).alias("q")).collect():
        assert r.q == pytest.approx(r.want)
    full = df.where("i = 0").select(text.quality_score(F.col("n"), F.col("c"), F.lit(True), F.lit("bob"))).first()[0]
    assert full == pytest.approx(1.0)


def test_normalize_edges(spark):
    base = ("N", "s", "d", "  fix <b>it</b>  ", "Solved", " team ", "", None)
    times = ["2026-05-01 10:00:00", "2026-5-1 9:0:0", "2026-05-01", None]
    df = spark.createDataFrame(
        [(f"N{i}", *base[1:], t) for i, t in enumerate(times)]
        + [("N8", "s", "d", "x", " Duplicate ", "t", "", None, times[0]), ("N9", "s", "d", "<br/>", None, "t", "c", "u", times[0])],
        "number string, short_description string, description string, close_notes string, close_code string, "
        "assignment_group string, category string, subcategory string, closed_at string")
    out = {r.number: r for r in cleaning.normalize_incidents(df).collect()}
    assert set(out) == {"N0", "N1"}
    assert out["N0"].close_notes == "fix it" and out["N0"].assignment_group == "team" and out["N0"].category is None
    assert out["N1"].closed_at_iso == "2026-05-01T09:00:00"
    c = cleaning.gate_counts(df, 0.0).first()
    assert (c.extracted, c.kept, c.filtered) == (6, 2, 4)


def test_chunk_edges(spark):
    sizes = [0, 1, 400, 401, 750, 751, 1100]
    df = spark.createDataFrame([(n, " ".join(f"w{i}" for i in range(n))) for n in sizes], "n int, text string")
    rows = documents.chunk_documents(df, ["n"], "text").collect()
    by = {n: sorted((r.chunk_index, r.chunk, r.token_count) for r in rows if r.n == n) for n in sizes}
    assert [len(by[n]) for n in sizes] == [1, 1, 1, 2, 2, 3, 3]
    for n in sizes[1:]:
        words = by[n][0][1].split()
        for _, chunk, count in by[n][1:]:
            assert chunk.split()[:50] == words[-50:]
            words += chunk.split()[50:]
            assert count == len(chunk.split())
        assert words == [f"w{i}" for i in range(n)]              # chunks rebuild the text


def test_confidence_and_decision(spark):
    df = spark.createDataFrame([(0.80, 17, 0.85, 0.70)], "c double, n int, s double, f double")
    got = df.select(scoring.confidence(*[F.col(c) for c in "cnsf"])).first()[0]
    assert got == pytest.approx(0.787, abs=0.01)
    sims = [(0.95, "update"), (0.92, "update"), (0.86, "review"), (0.80, "review"), (0.79, "create"), (None, "create")]
    df = spark.createDataFrame(sims, "s double, want string")
    assert all(r[0] == r[1] for r in df.select("want", scoring.dedup_decision(F.col("s"))).collect())


@pytest.mark.parametrize("messages,errors,want", [
    (["connection refused", "x"], 1, "db_connection"), (["java heap"], 5, "memory"), (["ClassNotFound"], 1, "deployment"),
    (["other"], 150, "high_error_rate"), (["other"], 5, "unknown")])
def test_error_classes(spark, messages, errors, want):
    df = spark.createDataFrame([(messages, errors)], "m array<string>, e int")
    assert df.select(rules.error_class(F.col("m"), F.col("e"))).first()[0] == want


def test_tags(spark):
    df = spark.createDataFrame([(["x", "app:a:b", "app:c"],), (["x"],), ([],)], "t array<string>")
    assert [r[0] for r in df.select(rules.first_tag_value(F.col("t"), "app:")).collect()] == ["a:b", None, None]


def test_embedder_failures(spark):
    def picky(texts):
        if any("bad" in t for t in texts):
            raise ValueError
        return [[1.0, 2.0] if t != "long" else [1.0, 2.0, 3.0] for t in texts]
    df = spark.createDataFrame([("a",), ("bad",), ("  ",), (None,), ("long",), ("b",)], "t string").coalesce(1)
    got = [list(r.embedding) for r in documents.embed_texts(df, "t", picky, 2, batch_size=3).collect()]
    assert got == [[1, 2], [0, 0], [0, 0], [0, 0], [0, 0], [1, 2]]


def test_runbook_seed(spark):
    df = spark.createDataFrame([("Restart The Interface Engine On Every Single Node", "do it")], "title string, content string")
    r = documents.runbook_documents(df).first()
    assert r.source_id == "restart_the_interface_engine_on_every_si"


def test_missing_fields(spark):
    df = spark.createDataFrame([("a", None)], "number string, category string")
    assert cleaning.missing_fields(df, ["number", "closed_at"]) == ["closed_at"]
    got = {r.field: (r.present, r.non_null) for r in cleaning.field_coverage(df, ["number", "category", "x"]).collect()}
    assert got == {"number": (True, 1), "category": (True, 0), "x": (False, 0)}
