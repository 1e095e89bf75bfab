"""Parts of the operators on their own."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tests.llm import fixtures as X
from triagelake.llm import ann, automata, components, idfiles, langid, packing, pii, quality, resampling, simhash, suffixes, tiling, tokens


@given(st.text(alphabet="a1.@-+ _%()9é", max_size=60))
@settings(max_examples=400, deadline=None)
def test_base_spans(text):
    assert pii.base_spans(text) == X.personal(text)


def test_base_spans_stay_linear():
    for text in ("a" * 200_000, "1." * 100_000, "a@" * 100_000, "+1" * 100_000, "1 " * 100_000, "9" * 10_000 + ".1.1.1"):
        pii.base_spans(text)


def test_disclosing_terms(spark):
    """A word that only occurs beside a protected address is removed, common words stay."""
    docs = [(i, f"the owner zorro is at zed@corp.example and the rest is text {i}") for i in range(4)]
    docs += [(10 + i, f"the text of number {i} is at the office") for i in range(60)]
    out = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all("zorro" not in out[i] and "zed@" not in out[i] and "[EMAIL]" in out[i] for i in range(4))
    assert all(out[i] == t for i, t in docs if i >= 10)


def test_terms_of_an_entity_seen_once(spark):
    """A name far from the only address that spells it, and in another document without it, is replaced; no other word."""
    far = " ".join(["the text of the office"] * 5)
    docs = [(0, f"Zorro wrote. {far} zorro.d@corp.example {far}"), (1, "the office of zorro is the text")]
    docs += [(10 + i, f"the text of the office {i}") for i in range(2000)]
    out = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[0] == f"[TERM] wrote. {far} [EMAIL] {far}" and out[1] == "the office of [TERM] is the text"
    assert all(out[i] == t for i, t in docs if i >= 10)


def test_rare_ordinary_words_stay(spark):
    """1,000 words of one or two rows each, beside addresses seen once and beside copies of one text, tell nothing."""
    rnd = random.Random(12)
    rare = ["".join(rnd.choice("abcdefghiklmnoprstuvw") for _ in range(9)) for _ in range(1000)]
    docs = [(i, f"the text {' '.join(rare[10 * i:10 * i + 10])} of box{i}q@corp.example is here") for i in range(100)]
    docs += [(200 + i, f"once more {i}, " + docs[3][1]) for i in range(6)]                  # near copies
    docs += [(300 + i, f"the text of {' '.join(rnd.sample(rare, 2))} is here") for i in range(500)]
    out = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(out[i] == " ".join("[EMAIL]" if "@" in w else w for w in t.split()) for i, t in docs)


def g_squared(n, n_c, n_t, n_ct):
    cells = [(n_ct, n_c, n_t), (n_c - n_ct, n_c, n - n_t), (n_t - n_ct, n - n_c, n_t), (n - n_c - n_t + n_ct, n - n_c, n - n_t)]
    return 2 * sum(x * np.log(x * n / (r * c)) for x, r, c in cells if x > 0)


def test_disclosures_against_brute_force(spark):
    rnd = random.Random(9)
    docs = [" ".join(rnd.choices([f"w{c}" if c > "m" else c * 3 for c in "abcdefghijklmnopqrst"], k=4))
            + rnd.choice(["", "", "", " a@b.c", " dd.eee@e.f and a@b.c", " 1.2.3.4 eee"]) for _ in range(300)]
    docs += docs[:30] + [f"only here {docs[0]} zzz zzz.k@y.z q@y.z"]
    rows = [({t[s:e] for s, _, e in X.personal(t)}, {w for w in t.split() if w.isalpha()},
             tuple(t[max(0, s - 40):e + 40] for s, _, e in X.personal(t))) for t in docs]
    n, z, least, error = len(rows), 1.0, 0.3, 0.05
    sources = {}
    for c, t, k in rows:
        if c:
            sources.setdefault(k, [c, t, 0])[2] += 1
    judged = sum(len(c) * len(t) for c, t, _ in sources.values())
    want, signed = {}, 0
    anywhere = [set(re.findall("[a-z]+", t)) for t in docs]
    for c in set().union(*(e for e, _, _ in sources.values())):
        n_c = sum(c in e for e, _, _ in sources.values())
        for t in set().union(*(w for e, w, _ in sources.values() if c in e)):
            both = [m for e, w, m in sources.values() if c in e and t in w]
            n_ct = len(both)
            n_t = max(n_ct, sum(t in w for w in anywhere) - sum(both) + n_ct)
            p = n_ct / n_c
            low = (p + z * z / (2 * n_c) - z * (p * (1 - p) / n_c + z * z / (4 * n_c * n_c)) ** 0.5) / (1 + z * z / n_c)
            share = float(np.log(n * low / n_t) / np.log(n / n_c))
            sign = "@" in c and t in [w for w in c.split("@")[0].split(".") if len(w) > 2]
            evident = n_ct > 1 and g_squared(n, n_c, n_t, n_ct) >= 2 * np.log(judged / error)
            if share >= least and (sign or evident):
                want[pii._key(t)] = max(share, want.get(pii._key(t), 0.0))
                signed += sign
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.term: r.disclosure for r in pii.disclosures(df, pii._scan(df, "doc_id", "text"), least=least).collect()}
    assert want and signed and got == pytest.approx(want)


def test_all_words_of_a_source_count(spark):
    """Near copies are one source with the words of each; n(t) is freed of just the rows that have the word."""
    around = " ".join(["the text of the office"] * 3)
    near = [f"{w} {around} jo.zorro@corp.example {around}" for w in ("alpha", "zorro", "gamma", "gamma", "gamma")]
    other = [f"{w} beside jo.zorro@corp.example" for w in ("alpha zorro gamma", "once alpha zorro")]
    docs = near + other + [f"the text of the office {i}" for i in range(400)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.term: r.disclosure for r in pii.disclosures(df, pii._scan(df, "doc_id", "text"), least=0.1, error=1e9).collect()}
    n, n_c, z = len(docs), 3, 1.0
    for word, n_ct in (("alpha", 3), ("zorro", 3), ("gamma", 2)):
        p = n_ct / n_c
        low = (p + z * z / (2 * n_c) - z * (p * (1 - p) / n_c + z * z / (4 * n_c * n_c)) ** 0.5) / (1 + z * z / n_c)
        n_t = n_ct + (word == "zorro") * 5      # the five others have it in the address
        n_t -= (word == "zorro") * 1            # one of them is among the rows that have the word
        assert got[pii._key(word)] == pytest.approx(np.log(n * low / n_t) / np.log(n / n_c)), word


def test_clashing_columns(spark):
    """Columns named like the operators' own keep their values, and one row of a group stays."""
    docs = spark.createDataFrame([(1, "some words to keep jo@corp.example", i, i, "a", "b", "c") for i in range(3)],
                                 "doc_id long, text string, _id long, _g long, _h string, _t string, _spans string")
    safe = pii.sanitise(docs)
    assert safe.columns == docs.columns
    assert sorted(map(tuple, safe.collect())) == [(1, "some words to keep [EMAIL]", i, i, "a", "b", "c") for i in range(3)]
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and kept.count() == 1


def test_replaced_overlaps():
    spans = [{"kind": "card", "start": 0, "end": 5}, {"kind": "ip", "start": 3, "end": 8}, {"kind": "removed", "start": 9, "end": 10}]
    assert pii.replaced("abcdefghijk", spans) == "[CARD]ik"


@pytest.mark.parametrize("kind", ["byte", "bit"])
def test_planes_round_trip(kind):
    rng = np.random.default_rng(3)
    for n, top in ((0, 2), (1, 1), (5, 70_000), (1000, 49_408), (4097, 2**32 - 1), (10, 1)):
        ids = rng.integers(0, top, n, dtype=np.uint64).astype("<u4")
        payload, planes, frames = idfiles.compress(ids, kind, 512, 3)
        assert np.array_equal(idfiles.decompress(payload, n, planes, frames, kind, 512), ids)


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=30))
@settings(max_examples=200, deadline=None)
def test_packs_hold_every_length_once(histogram):
    packs = packing.shortest_pack_first(dict(histogram), 64)
    seen = {}
    for lengths, count in packs:
        assert sum(lengths) <= 64 and count > 0
        for n in lengths:
            seen[n] = seen.get(n, 0) + count
    assert seen == histogram


def test_pieces_join_to_the_text():
    for t in ("", " ", "a b", "a  b", "a\nb c", "a \nb", "\n", "a\tb c", " a", "a ", "a  b"):
        assert "\n".join(" ".join(line) for line in tokens.pieces(t)) == t


def test_cache_is_bounded():
    c = tokens.Generations(10)
    for i in range(1000):
        c.put(i, i)
    assert len(c.young) + len(c.old) <= 10 and c.get(999) == 999


def test_rolling_windows():
    ids = np.array([random.Random(2).randint(0, 3) for _ in range(60)])
    for n in (1, 2, 3, 5, 7, 16, 20, 60, 61):
        h, keys = tiling.windows(ids, n), [tuple(ids[i:i + n]) for i in range(len(ids) - n + 1)]
        assert len(h) == len(keys)
        assert all((h[i] == h[j]) == (keys[i] == keys[j]) for i, j in itertools.combinations(range(len(keys)), 2))


def test_tiles_of_reordered_passages():
    item = np.arange(40)
    doc = np.concatenate([np.full(5, -1), item[20:], [-1, 3, -1], item[:17], [-1]])
    assert sorted(tiling.tiles(item, doc)) == [(17, 0, 28), (20, 20, 5)]
    assert tiling.tiles(item, np.arange(100, 140)) == [] and tiling.tiles(item[:3], item) == []


@given(st.lists(st.integers(0, 2), min_size=5, max_size=30), st.lists(st.integers(-1, 2), max_size=60))
@settings(max_examples=200, deadline=None)
def test_tiles_are_matches_without_overlap(item, doc):
    item, doc = np.array(item), np.array(doc, np.int64)
    used_i, used_d = set(), set()
    for n, i, d in tiling.tiles(item, doc):
        assert n >= tiling.SEED and np.array_equal(item[i:i + n], doc[d:d + n])
        assert used_i.isdisjoint(range(i, i + n)) and used_d.isdisjoint(range(d, d + n))
        used_i |= set(range(i, i + n))
        used_d |= set(range(d, d + n))


@given(st.integers(5, 60), st.lists(st.integers(1, 59), max_size=8), st.randoms(use_true_random=False))
@settings(max_examples=300, deadline=None)
def test_tiles_of_distinct_words_are_the_common_runs(n, cuts, rnd):
    """Where no word is there twice no matches compete: the tiles are all common runs of seed length or more."""
    ends = sorted({0, n, *(c for c in cuts if c < n)})
    parts = [list(range(a, z)) for a, z in itertools.pairwise(ends)]
    rnd.shuffle(parts)
    doc = [w for p in parts if rnd.random() < 0.8 for w in [*p, *[-1] * rnd.randint(0, 2)]]
    runs, at = [], 0
    while at < len(doc):
        z = at + 1
        while z < len(doc) and doc[z] == doc[z - 1] + 1 and doc[at] >= 0:
            z += 1
        if doc[at] >= 0 and z - at >= tiling.SEED:
            runs.append((z - at, doc[at], at))
        at = z
    assert sorted(tiling.tiles(np.arange(n), np.array(doc, np.int64))) == sorted(runs)


def brute_offsets(group, strings, length):
    out = []
    windows = [{b: (left[:b], s[:length - b]) for b in range(len(left) + 1) if length - b <= len(s)}
               for s, (_, _, left, _) in zip(strings, group)]
    for i, w in enumerate(windows):
        bits = 0
        for b, key in w.items():
            n = sum(group[j][3] for j, v in enumerate(windows) if v.get(b) == key)
            bits |= (n > 1) << b
        out.append(bits)
    return out


@pytest.mark.parametrize("m", [1, 2, 9, 24, 25, 60])
def test_repeated_offsets(m):
    rnd = random.Random(m)
    for _ in range(30):
        rights = sorted({(("a" * 4 + "".join(rnd.choice("ab") for _ in range(rnd.randint(4, 8)))).encode(),
                          "".join(rnd.choice("ab") for _ in range(rnd.randint(0, 6))).encode()) for _ in range(m)})
        strings = [r for r, _ in rights]
        group = [(suffixes.common(strings[i - 1], s) if i else 0, len(s), left, rnd.choice([1, 1, 1, 2]))
                 for i, (s, left) in enumerate(rights)]
        assert suffixes.repeated_offsets(group, 12) == brute_offsets(group, strings, 12)


@given(st.lists(st.lists(st.binary(max_size=6), max_size=12), min_size=1, max_size=9))
@settings(max_examples=200, deadline=None)
def test_loser_tree(runs):
    runs = [sorted(r) for r in runs]
    coded = [[(s, suffixes.common(r[i - 1], s) if i else 0, None) for i, s in enumerate(r)] for r in runs]
    merged = list(suffixes.LoserTree(coded))
    strings = [s for s, _, _ in merged]
    assert strings == sorted(s for r in runs for s in r)
    assert all(h == suffixes.common(a, b) for a, (b, h, _) in zip(strings, merged[1:]))


def test_front_coding_round_trip():
    entries = sorted({(bytes([1, 2]) * n, b"left"[:n % 5], n % 2) for n in range(40)})
    entries = [(s, left, f, [(i, i + 1)] * (1 + i % 3)) for i, (s, left, f) in enumerate(entries)]
    back = list(suffixes.decoded(suffixes.front_coded(entries)))
    assert [(s, p[0], p[1], p[2].tolist()) for s, _, p in back] == [(s, a, f, [list(x) for x in at]) for s, a, f, at in entries]


def test_long_texts_are_hashed_in_segments(monkeypatch):
    text = bytes(random.Random(1).choice(b"ab") for _ in range(5000))
    whole = suffixes.anchors([text, text[100:]], 50, 16)
    monkeypatch.setattr(suffixes, "SEGMENT", 300)
    parts = suffixes.anchors([text, text[100:]], 50, 16)

    def owners(found):
        return {(t, s): p for t, p, _, a, z in zip(*(c.tolist() for c in found)) for s in range(a, z + 1)}
    assert owners(whole) == owners(parts) and len(owners(whole)) == 4951 + 4851


def test_components_of_a_chain_and_a_star(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(1, j) for j in range(2, 80)] + [(500, 500)]
    got = {r.a: r.b for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 100 for i in range(101, 161)} | {j: 1 for j in range(2, 80)}


@pytest.mark.parametrize("bits", [1, 2, 3])
def test_ball_links(spark, bits):
    rnd = random.Random(bits)
    seeds = [rnd.getrandbits(64) for _ in range(12)]
    prints = sorted({s ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(0, 4))) for s in seeds for _ in range(8)})
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    links = simhash.links(spark.createDataFrame(signed, "fp long"), bits).collect()
    root = {p[0]: p[0] for p in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for r in links:
        assert (r.a ^ r.b).bit_count() <= 64 and bin((r.a ^ r.b) & (1 << 64) - 1).count("1") <= bits
        x, y = find(r.a), find(r.b)
        root[max(x, y)] = min(x, y)
    want = X.classes(prints, bits)
    same = {}
    for (p,), c in zip(signed, want):
        same.setdefault(c, set()).add(find(p))
    assert all(len(v) == 1 for v in same.values()) and len({next(iter(v)) for v in same.values()}) == len(same)


def test_ranking_separates(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, quality.WIDTH))
    good = x[:, 3] + 0.1 * rng.normal(size=2000) > -1
    r = quality.rank(x[:1800], good[:1800])
    assert ((r.scores(x[1800:]) >= quality.CUT_SCORE) == good[1800:]).mean() > 0.95
    assert (quality.rank(x[:5], np.ones(5, bool)).scores(x[:2]) == 1).all()
    assert (quality.rank(x[:0], np.zeros(0, bool)).scores(x[:2]) == 0.5).all()


def test_ranking_is_the_least_pairwise_loss():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, quality.WIDTH))
    good = x[:, 0] + rng.normal(size=60) > 0
    r = quality.rank(x, good, 500, seed=5)
    z = np.clip((x - x.mean(0)) / (x.std(0) + 1e-6), -8, 8)
    again = np.random.default_rng(5)
    pairs = list(zip(again.choice(np.flatnonzero(good), 500), again.choice(np.flatnonzero(~good), 500), strict=True))

    def loss(w):
        return sum(np.log1p(np.exp(-(z[a] - z[b]) @ w)) for a, b in pairs) / 500 + quality.RIDGE / 2 * w @ w

    least = loss(r.weights)
    for i in range(quality.WIDTH):
        for step in (-1e-3, 1e-3):
            assert loss(r.weights + step * np.eye(quality.WIDTH)[i]) > least


@pytest.mark.parametrize("bad", [0, 3, 900])
def test_the_fit_takes_all_labelled_rows(spark, monkeypatch, bad):
    """Mean, steps and cut are those of all rows, with one kind rare or missing; a row beyond any sample moves them."""
    monkeypatch.setattr(quality, "BUCKET", 256)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(3000, quality.WIDTH)).astype(np.float32)
    good = np.arange(3000) >= bad
    x[~good, 4] -= 2
    x[-1, 7] = 1e6
    table = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "doc_id long, x array<float>").repartition(5)
    labels = spark.createDataFrame([(i, int(g)) for i, g in enumerate(good)], "doc_id long, quality int")
    r = quality.fit(table, labels)
    if not bad:
        assert r.prior == 1.0
        return
    assert np.allclose(r.mean, x.astype(float).mean(0)) and np.allclose(r.scale, x.astype(float).std(0) + 1e-6)
    u = np.sort(r.utilities(x.astype(float)))
    assert r.cut == pytest.approx((u[bad - 1] + u[bad]) / 2, abs=1e-9) and (bad < 9 or r.weights[4] > 0.5)
    from triagelake.llm.common import stored
    known = stored(table.join(labels, "doc_id").select(F.col("quality").alias("_good"), "x", F.xxhash64("doc_id", "x").alias("_h")))
    d = np.concatenate([quality._differences(p.good, p.bad, r.mean, r.scale) for p in quality._dealt(known, 3000 - bad, bad).collect()])
    assert len(d) >= quality.PARTNERS * (3000 - bad)
    assert np.abs(quality.RIDGE * r.weights - d.T @ (1 / (1 + np.exp(d @ r.weights))) / len(d)).max() < 1e-6


def test_values_at_a_rank(spark):
    for values in ([1.0, 1.0, 1.0], [0.5, 1e-9, 1e9, 1e9, -3.0], [1.0] * 50 + [1.0 + 1e-15] * 3 + [-1e300, 2.0]):
        df = spark.createDataFrame([(v,) for v in values], "u double")
        want = sorted(values)
        for k in range(1, len(values)):
            if k % 7 == 1 or k > 48:
                assert quality._at_rank(df, k) == (want[k - 1] + want[k]) / 2


def test_the_fit_sees_a_bounded_number_of_rows(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "rank", lambda x, good, pairs: seen.append(len(x)))
    # One id holds a third of all rows, another a third under ever new vectors.
    x = F.transform(F.sequence(F.lit(1), F.lit(quality.WIDTH)), lambda i: (F.col("v") * i).cast("float"))
    table = (spark.range(3000).select(F.greatest(F.col("id") - 2000, F.lit(0)).alias("doc_id"), F.when(
        F.col("id") < 1000, 0).otherwise(F.col("id")).alias("v")).select("doc_id", x.alias("x")))
    labels = spark.range(1000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    quality.fit(table, labels, sample_rows=300)
    quality.fit(table, labels, sample_rows=5000)
    assert 120 < seen[0] < 400 and seen[1] == 2001


def brute_neighbours(rows, queries, k):
    good = [(i, np.array(v, float)) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v) and any(v)
            and len(v) == 8]
    out = {}
    for q, x in good:
        if q in queries:
            out[q] = sorted((float(np.sqrt(((x - y) ** 2).sum())), i) for i, y in good if i != q)[:k]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.normal(size=8) + 4 * (i % 5)]) for i in range(600)]
    rows += [(1000 + i, rows[7][1]) for i in range(40)]                     # copies
    rows += [(2000, None), (2001, []), (2002, [0.0] * 8), (2003, [float("nan")] * 8), (2004, [1.0] * 7),
             (2005, [None] + [1.0] * 7), (2006, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.neighbours(df, df.where("vec_id % 20 = 0 or vec_id = 7"))
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.score, r.vec_id))
    rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    want = brute_neighbours(rows, {i for i, _ in rows if i % 20 == 0 or i == 7}, 10)
    assert set(found) == set(want)
    hits = sum(len({i for _, i in found[q]} & {i for _, i in w}) for q, w in want.items())
    assert hits >= 0.95 * sum(len(w) for w in want.values())
    assert [i for _, i in found[7]] == [1000 + i for i in range(10)] and found[7][0][0] == 0.0


def test_neighbours_of_large_and_near_equal_vectors(spark):
    """One vector of 1e8 and 2,000 near copies among usual ones: all keep their nearest."""
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(400, 8)), 1 + 1e-4 * rng.normal(size=(2000, 8)), np.full((1, 8), 1e8)])
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    found = {}
    for r in ann.neighbours(df, df.where("vec_id % 40 = 0")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute_neighbours(rows, set(range(0, 2401, 40)), 10)
    assert set(found) == set(want)
    for some in (range(0, 400, 40), range(400, 2400, 40)):
        assert sum(len(found[q] & {i for _, i in want[q]}) for q in some) >= 0.95 * 10 * len(some)


@pytest.mark.parametrize("n", [0, 1, 3])
def test_few_vectors(spark, n):
    df = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(n)], "vec_id long, embedding array<float>")
    assert ann.neighbours(df, df).groupBy("query_id").count().where(F.col("count") != n - 1).count() == 0


@given(st.lists(st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=14), st.integers(1, 2)),
                min_size=1, max_size=6), st.integers(1, 6))
@settings(max_examples=300, deadline=None)
def test_matching_statistics(strings, least):
    """Where a string of `least` words that occurs twice ends, the statistic says so, and nowhere else."""
    seen = {}
    for words, times in strings:
        for i in range(len(words) - least + 1):
            key = tuple(words[i:i + least])
            seen[key] = seen.get(key, 0) + times
    made = automata.Automaton.build(strings, least)
    assert (made is None) == (max(seen.values(), default=0) < 2)
    if made:
        back = automata.Automaton.from_bytes(made.to_bytes())
        for words, _ in [*strings, ([b"a", b"x", *strings[0][0], b"b", b"c", b"a", b"b"], 1)]:
            want = [e >= least and seen.get(tuple(words[e - least:e]), 0) > 1 for e in range(1, len(words) + 1)]
            assert [n >= least for n in back.statistics(words)] == want


def test_regions_cover_every_window_once(monkeypatch):
    rnd = random.Random(8)
    texts = [b" ".join(rnd.choice([b"a", b"bb", b"c"]) for _ in range(n)) + b"\n\t" for n in (0, 5, 34, 35, 36, 400, 3000)]
    monkeypatch.setattr(automata, "SEGMENT", 128)
    monkeypatch.setattr(automata, "_powers", {})
    found = automata.regions(texts, 35, 12)
    windows, grams = [], {}
    for t, g, _, first, size in zip(*(c.tolist() for c in found)):
        words = texts[t].split()
        for s in range(first, first + size - 34):
            windows.append((t, s))
            assert grams.setdefault(tuple(words[s:s + 35]), g) == g
    assert sorted(windows) == [(i, s) for i, t in enumerate(texts) for s in range(len(t.split()) - 34)]


@pytest.mark.parametrize("n", [1, 2, 3])
def test_overlapped_spans(n):
    text = resampling.collapsed("Élan  vital! a-b, C3 \n x".encode())
    words = text.decode().split(" ")
    assert words == ["Élan".replace("É", "É"), "vital", "a", "b", "c3", "x"]
    want = [" ".join(words[i:i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]
    assert [m[0].decode() for m in resampling.spans(text, n)] == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_every_letter_as_the_library(name):
    """Every character of the basic plane, and letters beyond, before a mark, before 're and inside a word."""
    path = public_tokenizers.path(name)
    library, ours = Tokenizer.from_file(path), tokens.Encoder(path, 2000)
    chars = [chr(c) for c in [*range(1, 0xD800), *range(0xE000, 0x10000), *range(0x10400, 0x10450), *range(0x1D400, 0x1D440),
                              *range(0x1F600, 0x1F620), *range(0x20000, 0x20010), *range(0x1E900, 0x1E944)]]
    for c in chars:
        t = f"{c}. A{c}, x a{c}b {c}'re 1{c}1 x{c}! {c}"
        assert ours.encode(t).tolist() == library.encode(t, add_special_tokens=False).ids, hex(ord(c))


def plain_language(train, text):
    """Posterior by the definition: word counts, else the longest known gram at each place of a word."""
    langs = sorted({lang for _, lang in train})
    words = {lang: Counter(w for t, one in train if one == lang for w in langid.words_of(t)) for lang in langs}
    known = {w for lang in langs for w, n in words[lang].items() if n > 1}
    grams = {lang: Counter() for lang in langs}
    for lang in langs:
        for w, n in words[lang].items():
            p = f"<{w}>"
            for g in {p[a:z] for a in range(len(p)) for z in range(a + 1, min(len(p), a + 4) + 1)}:
                grams[lang][g] += n

    def log_share(counts, item, kind):
        totals = {lang: sum(n for i, n in counts[lang].items() if kind(i)) for lang in langs}
        return [math.log(counts[lang][item] / max(totals[lang], 1) + 0.1 / max(totals.values())) for lang in langs]

    total = [0.0] * len(langs)
    for w in langid.words_of(text):
        if w in known:
            one = log_share(words, w, known.__contains__)
        else:
            p, one = f"<{w}>", [0.0] * len(langs)
            for i in range(len(p)):
                g = next((p[i:z] for z in range(min(len(p), i + 4), i, -1) if any(p[i:z] in grams[x] for x in langs)), None)
                if g:
                    rows = log_share(grams, g, lambda x, n=len(g): len(x) == n)
                    one = [a + b + (4 - len(g)) * math.log(0.4) for a, b in zip(one, rows)]
            one = [a / len(p) for a in one]
        total = [a + b for a, b in zip(total, one)]
    best = max(range(len(langs)), key=lambda i: total[i])
    return langs[best], 1 / sum(math.exp(t - total[best]) for t in total)


def test_language_by_the_definition(spark):
    rnd = random.Random(12)
    train = [(X.prose(rnd, 12), "en") for _ in range(12)] + [(X.prose(rnd, 12, "äöüßchgn"), "de") for _ in range(5)] \
        + [(X.prose(rnd, 12, "abcxyz"), "xx") for _ in range(7)]
    model = langid.fit(spark.createDataFrame(train, "text string, lang string"))
    texts = [X.prose(rnd, 3, letters) for letters in ("äöüßchgn", "abcxyz", "chgnxa", "eèq") for _ in range(4)]
    texts += [train[0][0], train[15][0] + " " + train[20][0], "Ω", "a", "zzzzzz ß"]
    for text, (lang, score) in zip(texts, model.predict(texts), strict=True):
        want, p = plain_language(train, text)
        assert lang == want and abs(score - p) < 1e-9


def test_a_rare_language_keeps_its_words(spark):
    """A language with a hundredth of the rows has tables of its own; copies of one text are thinned with the sample."""
    rnd = random.Random(6)
    rows = [(X.prose(rnd, 40), "en") for _ in range(400)] + [(X.prose(rnd, 40, "äöüßchgn"), "de") for _ in range(4)]
    model = langid.fit(spark.createDataFrame(rows, "text string, lang string"), words=200, grams=60)
    assert [p[0] for p in model.predict([X.prose(rnd, 8, "äöüßchgn") for _ in range(20)])] == ["de"] * 20
    copies = spark.createDataFrame(rows + rows[:1] * 2000, "text string, lang string")
    few = langid.fit(copies, sample_rows=500)
    assert few.langs and few.predict([rows[1][0]])[0][0] == "en"
