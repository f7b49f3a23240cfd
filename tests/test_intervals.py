"""Interval sweeps against plain loops, in one long recording, and the shape of their plans."""

import random
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from strandline.operators import intervals as I
from strandline.operators import sequences as X


def drawn(seed, n=60):
    r = random.Random(seed)
    points = [(r.choice([1, 2, 3, None]), r.choice([None, *range(30)]), k) for k in range(n)] + [(1, 5, 0)] * 2
    spans = [(r.choice([1, 2, 4, None]), a := r.randint(0, 30), r.choice([a, a - 2, a + r.randint(0, 12), None]), r.randint(0, 3)) for _ in range(25)]
    return points, [*spans, (1, 3, 9, 7), (1, 3, 9, 7)]


def tables(spark, points, spans):
    return spark.createDataFrame(points, "rec int, t int, k int"), spark.createDataFrame(spans, "rec int, a int, b int, k int")


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("closed", [(True, True), (False, False), (True, False), (False, True)])
def test_stab_gives_all_pairs(spark, seed, closed):
    points, spans = drawn(seed)
    p, v = tables(spark, points, spans)
    got = Counter((tuple(r["_p"]), tuple(r["_v"])) for r in I.stab(p, v, "t", "a", "b", closed=closed).collect())
    inside = lambda x, a, b: (a <= x if closed[0] else a < x) and (x <= b if closed[1] else x < b)
    want = Counter((x, s) for x in points for s in spans if x[0] is not None and x[0] == s[0] and None not in (x[1], s[1], s[2]) and inside(x[1], s[1], s[2]))
    assert got == want


@pytest.mark.parametrize("seed", range(3))
def test_counts_equal_plain_ones(spark, seed):
    points, spans = drawn(seed)
    p, v = tables(spark, points, spans)
    good = [s for s in spans if None not in s[:3] and s[1] <= s[2]]
    got = Counter(tuple(r) for r in I.with_point_counts(v, p, "t", "a", "b").collect())
    assert got == Counter((*s, sum(x[0] == s[0] and x[1] is not None and s[1] <= x[1] <= s[2] for x in points) if s in good else 0) for s in spans)
    rows = [x for x in points if x[0] is not None and x[1] is not None]
    before = {}
    want = Counter()
    for x in sorted(rows, key=lambda x: (x[0], x[1])):
        low = before.get(x[0], x[1])
        before[x[0]] = x[1]
        held = sum(s[0] == x[0] and s[1] <= x[1] <= s[2] for s in good)
        want[(x[0], x[1], held, sum(s[0] == x[0] and s[1] <= x[1] and s[2] >= low for s in good))] += 1
    found = I.with_interval_counts(p.where("rec IS NOT NULL AND t IS NOT NULL"), v, "t", "a", "b").collect()
    assert Counter((r["rec"], r["t"], r["n_open"], r["n_crossed"]) for r in found) == want


def test_empty_tables(spark):
    p, v = tables(spark, [], [])
    full, spans = tables(spark, [(1, 2, 3)], [(1, 0, 5, 9)])
    assert I.stab(p, spans, "t", "a", "b").count() == 0 == I.stab(full, v, "t", "a", "b").count()
    assert [tuple(r) for r in I.with_point_counts(spans, p, "t", "a", "b").collect()] == [(1, 0, 5, 9, 0)]
    assert [tuple(r) for r in I.with_interval_counts(full, v, "t", "a", "b").collect()] == [(1, 2, 3, 0, 0)]


def test_a_million_frames_in_one_recording(spark):
    frames = spark.range(1_000_000).select(F.lit(1).alias("rec"), F.col("id").alias("i"), (F.col("id") * 10).alias("t"))
    spans = spark.range(20_000).select(F.lit(1).alias("rec"), (F.col("id") * 500 + 3).alias("a"), (F.col("id") * 500 + 3 + F.col("id") % 7 * 100).alias("b"))
    began = time.perf_counter()
    met = I.stab(frames, spans, "t", "a", "b")
    assert met.count() == sum(b // 10 - (a - 1) // 10 for a, b in ((k * 500 + 3, k * 500 + 3 + k % 7 * 100) for k in range(20_000)))
    assert time.perf_counter() - began < 60
    counted = I.with_point_counts(spans, frames, "t", "a", "b").agg(F.sum("n_points")).first()[0]
    assert counted == met.count()


def test_no_range_join_and_one_shuffle_by_recording(spark):
    frames = spark.range(2000).select((F.col("id") % 5).alias("rec"), F.col("id").alias("i"), (F.col("id") * 33).alias("t"), (F.col("id") % 7 != 0).alias("p"))
    gaps = X.decided_gaps(frames, {"s": F.col("p")}, X.GapPolicy())
    plan = gaps._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    for df in (X.slice_and_rebase(frames, gaps.select("rec", "first_index", "last_index", "first_t")), X.gap_at(frames.select("rec", "t"), gaps)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan and ">=" not in "".join(x for x in plan.splitlines() if "Join" in x)


def test_differences_stop_at_preserved_gaps(spark):
    times = [0, 16_667, 33_333, 66_667]
    frames = spark.createDataFrame([(1, k, t, float(k * k)) for k, t in enumerate(times)], "rec int, i int, t int, v double")
    gaps = spark.createDataFrame([(1, 20_000, 30_000, "preserve_missing"), (1, 40_000, 50_000, "interpolate_linear")], "rec int, first_t int, last_t int, decision string")
    cut = X.with_barrier(frames, gaps)
    assert [r["barrier"] for r in cut.orderBy("i").collect()] == [False, False, True, False]
    found = X.differences(cut, "v", F.col("barrier")).orderBy("i").collect()
    assert [r["velocity"] is None for r in found] == [True, False, True, False]
