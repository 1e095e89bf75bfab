"""The sliding top-k structure and the window sweep against plain counting."""

import random
import time
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from triagelake.operators import intervals


def most(counts, k):
    return sorted(((i, n) for i, n in counts.items() if n), key=lambda x: (-x[1], x[0]))[:k]


@given(st.lists(st.tuples(st.sampled_from("abcdefgh"), st.integers(1, 3), st.booleans()), max_size=80), st.integers(1, 9))
@settings(max_examples=300, deadline=None)
def test_top_counts(changes, k):
    top, plain = intervals.TopCounts(), Counter()
    for item, n, add in changes:
        if add or plain[item] >= n:
            top.change(item, n if add else -n)
            plain[item] += n if add else -n
        assert top.top(k) == most(plain, k)


def test_cost_of_a_window_does_not_grow_with_the_items():
    def one(items):
        points = [(i, f"m{i:07d}", 1) for i in range(items + 2000)]
        windows = [(w, w + items, w) for w in range(2000)]
        top = time.perf_counter()
        assert sum(1 for _ in intervals._sweep(points, windows, 5)) == 10_000
        return time.perf_counter() - top
    small, large = min(one(2_000) for _ in range(3)), min(one(200_000) for _ in range(2))
    # 100 times the items: the points enter once (some 0.5 s), but no window scans them.
    assert large - small < 4.0


def test_windows_of_many_keys_blocks_and_lengths(spark, monkeypatch):
    monkeypatch.setattr(intervals, "PART_ROWS", 40)
    monkeypatch.setattr(intervals, "PART_WINDOWS", 7)
    rnd = random.Random(5)
    logs = [(rnd.choice("aaaab"), rnd.randint(0, 40_000), rnd.choice(["x", "y", "zz", "é", None, f"m{rnd.randint(0, 30)}"]))
            for _ in range(3000)]
    wins = [(i, rnd.choice("aaab"), lo := rnd.randint(-500, 41_000), lo + rnd.choice([0, 900, 3600, 20_000, -5]))
            for i in range(200)]
    ts = F.timestamp_seconds
    ldf = spark.createDataFrame(logs, "e string, s long, m string").select("e", ts("s").alias("ts"), "m")
    wdf = spark.createDataFrame(wins, "id long, e string, a long, z long").select("id", "e", ts("a").alias("lo"), ts("z").alias("hi"))
    for width in (600, 4 * 3600):
        got = {}
        for r in intervals.top_in_window(ldf, wdf, "e", "m", "id", 4, width).collect():
            got.setdefault(r.id, []).append((r.m, r.n))
        for i, e, a, z in wins:
            want = most(Counter(m for k, t, m in logs if k == e and a <= t <= z and m is not None), 4)
            assert sorted(got.get(i, []), key=lambda x: (-x[1], x[0])) == want
