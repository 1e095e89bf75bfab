"""Each registered query on a table of awkward rows, against a brute-force version."""

import hashlib
import random
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import fixtures as X
from triagelake.llm import automata, queries, suffixes


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    return X.folder(spark, tmp_path_factory.mktemp("tables"))


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    return X.folder(spark, tmp_path_factory.mktemp("empty"), [])


def result(spark, name, folder):
    return queries.QUERIES[name](spark, folder).collect()


def by_row(found, *cols):
    """Results in a comparable order."""
    return sorted((tuple(r[c] for c in cols) for r in found), key=repr)


def library(name, end=None):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    return {text: t.encode(text or "", add_special_tokens=False).ids + ([] if end is None else [end])
            for text in {r[1] for r in X.rows()}}


def test_op1(spark, folder):
    want = []
    for r in X.rows():
        spans = X.personal(r[1])
        text = ",".join(f"{X.PATTERNS[k][0]}:{a}:{z}" for a, k, z in spans)
        want.append((r[0], *[sum(k == j for _, k, _ in spans) for j in range(4)], hashlib.sha256(text.encode()).hexdigest()))
    got = result(spark, "op1_pii", folder)
    assert by_row(got, "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256") == sorted(want, key=repr)
    twelve = next(r for r in got if r.doc_id == 12)
    assert twelve.n_email >= 2 and twelve.n_card == 1 and twelve.n_ip >= 2 and twelve.n_phone == 1


def test_op2(spark, folder):
    got = result(spark, "op2_quality", folder)
    assert len(got) == len(X.rows()) and all(0 <= r.score <= 1 for r in got)
    assert all(r.predicted == (r.score >= 0.3) for r in got)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)


def test_op3(spark, folder):
    ids = library("word_bpe_49k.json", 2)
    got = sorted(result(spark, "op3_token_id_planes", folder), key=lambda r: r.start)
    keys = [-1 if r.doc_id is None else r.doc_id for r in got]
    assert keys == sorted(keys) and len(got) == len(X.rows())
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    want = sorted(((r[0], len(ids[r[1]]), X.crc(ids[r[1]])) for r in X.rows()), key=repr)
    assert by_row(got, "doc_id", "n_tokens", "ids_crc32") == want


def test_op4(spark, folder):
    ids = library("byte_bpe_50k.json")
    want = sorted(((r[0], len((r[1] or "").encode()), len(ids[r[1]]), len(ids[r[1]]) > 512) for r in X.rows()), key=repr)
    assert by_row(result(spark, "op4_token_counts", folder), "doc_id", "n_bytes", "n_tokens", "over_limit") == want


def test_op6(spark, folder):
    got = result(spark, "op6_decontamination", folder)
    assert len(got) == len(X.rows())
    hit = {r.doc_id: (r.item_id, r.coverage) for r in got if r.contaminated}
    assert set(hit) == {5, 6, 7} and all(v == (0, 1.0) for i, v in hit.items() if i in (5, 6))


@pytest.mark.parametrize("frequent", [4096, 2])
def test_op7(spark, folder, monkeypatch, frequent):
    monkeypatch.setattr(suffixes, "FREQUENT", frequent)
    want = [(r[0], *w) for r, w in zip(X.rows(), X.covered([r[1] for r in X.rows()], 200))]
    got = result(spark, "op7_suffix_dedup", folder)
    assert by_row(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)


def test_op7_with_texts_of_equal_hash(spark, folder, monkeypatch):
    monkeypatch.setattr(suffixes, "text_hash", lambda text: F.pmod(F.xxhash64(text), F.lit(7)))
    want = [(r[0], *w) for r, w in zip(X.rows(), X.covered([r[1] for r in X.rows()], 200))]
    got = result(spark, "op7_suffix_dedup", folder)
    assert by_row(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("texts_")]


def check_packing(got, ids):
    """Every id in one piece, sequences gapless and within the capacity."""
    whole, sequences = {}, {}
    for r in got:
        whole.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, r.length, r.ids_crc32))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == np.cumsum([0] + [n for _, n in pieces])[:-1].tolist()
        assert sum(n for _, n in pieces) <= 2048
    want = {}
    for key, one in ids:
        want.setdefault((key, len(one)), []).extend(
            (s, len(one[s:s + 2048]), X.crc(one[s:s + 2048])) for s in range(0, len(one), 2048))
    assert {k: sorted(v) for k, v in whole.items()} == {k: sorted(v) for k, v in want.items()}


def test_op8(spark, folder):
    ids = library("byte_bpe_50k.json", 1)
    check_packing(result(spark, "op8_packing", folder), [(r[0], ids[r[1]]) for r in X.rows()])


def test_op9(spark, folder):
    got = result(spark, "op9_language_id", folder)
    assert len(got) == len(X.rows())
    lang = {r[0]: r[2] for r in X.rows()}
    for r in got:
        if r.doc_id in (1, 2, 3, 4):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        if r.doc_id is not None and r.doc_id >= 20:
            assert r.lang_pred == lang[r.doc_id] and 0 <= r.score <= 1
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_op10(spark, folder):
    prints = [X.fingerprint(r[1]) for r in X.rows()]
    named = X.classes(prints, 2)
    least = {}
    for r, c in zip(X.rows(), named):
        if r[0] is not None:
            least[c] = min(least.get(c, r[0]), r[0])
    want = [(r[0], f"{p:016x}", least.get(c)) for r, p, c in zip(X.rows(), prints, named)]
    got = result(spark, "op10_simhash", folder)
    assert by_row(got, "doc_id", "fingerprint", "component_id") == sorted(want, key=repr)


def lined(rnd):
    """Texts of lines for the fill-in-middle query: sentinels, carriage returns, empty lines, no last line feed."""
    out = [(i, "".join(rnd.choice(["a line\n", "\n", "öß<\n", "x\r\n", "中 <S\n", "tail >"]) for _ in range(rnd.randint(0, 12))))
           for i in range(100, 200)]
    return out + [(300, "one <P> mark\nx"), (301, "l\n" * 50_000), (302, "y" * 300_000 + "\n$1 \\2\n"), (303, "\n"), (304, "\U0001F600\n\U0001F600")]


@pytest.mark.parametrize("wide, shard_words, wave_bytes", [(1000, 100_000, 1 << 20), (0, 50, 1), (2, 500, 4000)])
def test_op11(spark, folder, monkeypatch, wide, shard_words, wave_bytes):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    want = sorted(((r[0], *w) for r, w in zip(X.rows(), X.words_covered([r[1] for r in X.rows()], 35))), key=repr)
    got = automata.dedup(docs, wide=wide, shard_words=shard_words, wave_bytes=wave_bytes).collect()
    assert by_row(got, "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert by_row(result(spark, "op11_substring_dedup", folder), "doc_id", "n_words", "n_removed", "kept_sha256") == want


def test_op12(spark, folder):
    target = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
    got = result(spark, "op12_importance_resampling", folder)
    want = X.resampled([(r[0], r[1]) for r in X.rows()], target)
    assert by_row(got, "doc_id", "n_features", "weight", "score", "rank") == sorted(want, key=repr)
    assert sum(r.rank is not None for r in got) == sum(w[1] >= 20 for w in want) // 10 > 2


def test_op13(spark, folder, tmp_path):
    more = [(i, t, "en", "s", len(t), *"xy", 7, *"zqlab") for i, t in lined(random.Random(3))]
    for d, rows in ((folder, X.rows()), (X.folder(spark, tmp_path, more + X.rows()), more + X.rows())):
        want = []
        for r in rows:
            n, form, p, m, out = X.filled(r[0], r[1])
            want.append((r[0], n, form, p, m, hashlib.sha256(out.encode()).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest()))
        got = result(spark, "op13_fill_in_middle", d)
        cols = ("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")
        assert by_row(got, *cols) == sorted(want, key=repr)
        duck = duckdb.connect()
        duck.execute(f"create view documents as select * from '{d}/documents.parquet/*.parquet'")
        assert sorted(duck.execute(f"select {', '.join(cols)} from ({queries.ORACLES['op13_fill_in_middle']})").fetchall(),
                      key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - {"op5_nn_descent"}))
def test_empty_tables(spark, empty, name):
    assert result(spark, name, empty) == []


def test_pipeline(spark, folder):
    """Each stage on what the one before kept, by the brute-force versions of its decisions."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = corpus_pipeline.language_id(spark, docs, folder)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    left = kept.collect()
    assert {1, 2, 3, 4}.isdisjoint({r.doc_id for r in left}) and len(left) >= len(X.rows()) - 8
    named = X.classes([X.fingerprint(r.text) for r in left], 2)
    one = corpus_pipeline.near_duplicates(spark, kept, folder).collect()
    assert len(one) == len(set(named))
    for r in one:
        own = named[[x.text for x in left].index(r.text)]
        ids = [x.doc_id for x, c in zip(left, named) if c == own and x.doc_id is not None]
        assert r.doc_id == (min(ids) if ids else None)
    clean = corpus_pipeline.decontamination(spark, spark.createDataFrame(one, kept.schema), folder).collect()
    assert {r.doc_id for r in one} - {r.doc_id for r in clean} == {5, 6, 7}
    safe = corpus_pipeline.personal_data(spark, spark.createDataFrame(clean, kept.schema), folder).collect()
    assert len(safe) == len(clean) and not any(X.personal(r.text) for r in safe)
    assert "[EMAIL]" in next(r.text for r in safe if r.doc_id == 12) and all(r.n_chars == len(r.text) for r in safe)
    ids = {r.text: Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode(
        r.text, add_special_tokens=False).ids + [1] for r in safe}
    check_packing(corpus_pipeline.run(spark, folder).collect(), [(r.doc_id, ids[r.text]) for r in safe])


def test_empty_pipeline(spark, empty):
    assert corpus_pipeline.run(spark, empty).collect() == []
