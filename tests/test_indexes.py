"""The inverted file and the postings table against exact search."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from triagelake.operators import blocks, ivf, postings


def vectors(spark, n, dim=16, centres=30, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(centres, dim))[rng.integers(0, centres, n)] + 0.4 * rng.normal(size=(n, dim))
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "id long, vec array<double>")


def found(hits):
    out = {}
    for r in hits.collect():
        out.setdefault(r.pid, []).append((r.rank, r.cid, round(r.score, 9)))
    return {p: sorted(v) for p, v in out.items()}


def test_inverted_file(spark, tmp_path):
    df = vectors(spark, 6000)
    corpus, probes = blocks.prepare(df, "id", "vec", "cid"), blocks.prepare(df.where("id % 30 = 0"), "id", "vec", "pid")
    index = ivf.build(corpus.where("cid < 5000"), str(tmp_path / "ivf"), cells=24)
    index.append(corpus.where("cid >= 5000"))
    assert index.vectors.count() == 6000
    exact = found(blocks.topk(probes, corpus, 5, 0.3))
    assert found(ivf.search(index, probes, 5, 0.3, visits=24, block=100)) == exact
    some = found(ivf.search(index, probes, 5, 0.3, visits=6))
    hits = sum(len({c for _, c, _ in some.get(p, [])} & {c for _, c, _ in v}) for p, v in exact.items())
    assert hits >= 0.9 * sum(map(len, exact.values()))


@pytest.mark.parametrize("visits", [1, 3, 24, 99])
def test_a_probe_visits_no_more_cells_than_asked(spark, tmp_path, visits):
    df = vectors(spark, 1500)
    index = ivf.build(blocks.prepare(df, "id", "vec", "cid"), str(tmp_path / "ivf"), cells=24)
    cells = len(index.centres())
    got = ivf.visited(index, blocks.prepare(df, "id", "vec", "pid"), visits).groupBy("pid").agg(
        F.count("*").alias("n"), F.count_distinct("cell").alias("d"))
    assert {tuple(r) for r in got.select("n", "d").distinct().collect()} == {(min(visits, cells),) * 2}
    assert ivf.default_visits(16_384) == 256 and ivf.default_visits(4) == 4


@pytest.mark.parametrize("n", [0, 1, 2])
def test_few_vectors(spark, tmp_path, n):
    df = vectors(spark, 3).where(F.col("id") < n)
    index = ivf.build(blocks.prepare(df, "id", "vec", "cid"), str(tmp_path / "ivf"))
    got = found(ivf.search(index, blocks.prepare(df, "id", "vec", "pid"), 5, -1.0))
    assert {p: sorted(c for _, c, _ in v) for p, v in got.items()} == {i: list(range(n)) for i in range(n)}


def brute(docs, queries, k):
    words = {i: (t or "").lower().split() for i, t in docs}
    mean = sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    out = []
    for q, t in queries:
        scores = {}
        for w in sorted(set((t or "").lower().split())):
            idf = np.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5))
            for i, ws in words.items():
                if n := ws.count(w):
                    scores[i] = scores.get(i, 0.0) + idf * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(ws) / mean))
        best = sorted(((-round(s, 9), i) for i, s in scores.items()))[:k]
        out += [(q, i, round(-s, 6), r) for r, (s, i) in enumerate(best, 1)]
    return sorted(out)


def test_hits_of_common_terms_are_not_shuffled(spark, tmp_path):
    """Postings are dealt by document once; every query asks for a word of all documents."""
    docs = spark.range(400).select("id", F.concat(F.lit("the of and w"), F.col("id") % 50).alias("t"))
    index = postings.build(docs, "id", "t", str(tmp_path / "p"))
    queries = spark.range(20).select(F.col("id").alias("q"), F.concat(F.lit("the of and w"), F.col("id")).alias("t"))
    weights = postings._weights(index, queries, "q", "t").localCheckpoint()
    scored = postings._scored_by_document(index, weights)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query" not in plan and "hashpartitioning(doc" in plan
    assert scored.count() == 20 * 400


@pytest.mark.parametrize("common", [0.1, 1.0])
def test_postings_for_many_queries(spark, tmp_path, monkeypatch, common):
    """Without the broadcast, by candidates."""
    monkeypatch.setattr(postings, "BROADCAST_ROWS", 0)
    test_postings(spark, tmp_path, monkeypatch, common)


@pytest.mark.parametrize("common", [0.0, 0.1, 0.6, 1.0])
def test_postings(spark, tmp_path, monkeypatch, common):
    """Rare words, a word of almost all documents, queries of common words only, unknown words, nulls, copies."""
    monkeypatch.setattr(postings, "COMMON", common)
    rnd = random.Random(2)
    docs = [(i, " ".join(["the"] * rnd.randint(0, 3) + rnd.choices([f"w{int(rnd.expovariate(0.1))}" for _ in range(9)], k=rnd.randint(1, 30))))
            for i in range(300)]
    docs += [(300 + i, docs[i][1]) for i in range(20)] + [(400, None), (401, "")]
    queries = [(0, "the"), (1, "w1 W2 the w2"), (2, "w30 the nowhere"), (3, "nowhere"), (4, None), (5, ""), (6, "w0 w1 w2 w3 w4 the"),
               (7, "w25, w26; the")]
    index = postings.build(spark.createDataFrame(docs, "id long, t string"), "id", "t", str(tmp_path / "p"))
    got = postings.scores(index, spark.createDataFrame(queries, "q long, t string"), "q", "t", 7)
    rows = sorted((r["query"], r["doc"], round(r["score"], 6), r["rank"]) for r in got.collect())
    assert rows == brute(docs, [(q, (t or "").replace(",", " ").replace(";", " ")) for q, t in queries], 7)
