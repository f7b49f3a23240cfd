"""Edge cases with values by hand, and all short presence masks against a plain loop."""

import itertools
import random

from pyspark.sql import functions as F

from strandline.functions import scalars as S
from strandline.operators import metrics as M
from strandline.operators import models as J
from strandline.operators import sequences as X


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_grid(spark):
    grid = lambda span: one(spark, S.grid_times(F.lit(span).cast("bigint")))[0]
    assert grid(100_000) == [0, 33_333, 66_667, 100_000]
    assert grid(50_000) == [0, 33_333, 50_000]
    assert grid(0) == [0]


def test_rounding(spark):
    r = one(spark, S.ratio_ppm(F.lit(1), F.lit(3)), S.ratio_ppm(F.lit(2), F.lit(3)), S.ratio_ppm(F.lit(1), F.lit(2_000_000)), S.ratio_half_away(F.lit(5), F.lit(2)), S.ratio_half_away(F.lit(-5), F.lit(2)), S.ratio_ppm(F.lit(1), F.lit(0)))
    assert list(r) == [333_333, 666_667, 1, 3, -3, None]


def test_selection(spark):
    pick = lambda n: one(spark, S.uniform_indices(F.lit(n), 64))[0]
    assert pick(100)[0] == 0 and pick(100)[-1] == 99 and len(pick(100)) == 64 and all(a < b for a, b in zip(pick(100), pick(100)[1:]))
    assert pick(3) == [0, 1, 2] and pick(0) == []


def test_monotone_ms(spark):
    df = spark.createDataFrame([(0, k, t) for k, t in enumerate([0, 400, 900, 1100, 5000])], "rec bigint, i bigint, t bigint")
    assert [r["task_ms"] for r in X.monotone_ms(df).orderBy("i").collect()] == [0, 1, 2, 3, 5]


def test_missing_runs_of_all_short_masks(spark):
    masks = [m for n in range(1, 7) for m in itertools.product((True, False), repeat=n)]
    rows = [(k, i, i * 40_000, p) for k, m in enumerate(masks) for i, p in enumerate(m)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "rec bigint, i bigint, t bigint, p boolean").repartition(3)
    policy = X.GapPolicy()
    got = {(r["rec"], r["first_index"], r["last_index"], r["boundary"], r["duration"], r["decision"]) for r in X.decide_gaps(X.missing_intervals(df, {"s": F.col("p")}), policy).collect()}
    want = set()
    for k, m in enumerate(masks):
        i = 0
        while i < len(m):
            j = i
            while j < len(m) and not m[j]:
                j += 1
            if j > i:
                left, right = i > 0, j < len(m)
                kind = "internal" if left and right else "trailing" if left else "leading" if right else "entire_sequence"
                span = ((j if right else j - 1) - (i - 1 if left else i)) * 40_000
                ok = kind == "internal" and j - i <= 2 and span <= 100_000
                want.add((k, i, j - 1, kind, span, "interpolate_linear" if ok else "preserve_missing"))
            i = max(j, i + 1)
    assert got == want


def test_gap_limits_are_inclusive(spark):
    rows = [(0, 0, 0, True), (0, 1, 50_000, False), (0, 2, 100_000, True), (1, 0, 0, True), (1, 1, 50_000, False), (1, 2, 100_001, True)]
    df = spark.createDataFrame(rows, "rec bigint, i bigint, t bigint, p boolean")
    got = {r["rec"]: r["decision"] for r in X.decide_gaps(X.missing_intervals(df, {"s": F.col("p")}), X.GapPolicy()).collect()}
    assert got == {0: "interpolate_linear", 1: "preserve_missing"}


def test_best_episode_prefers_motion_then_start(spark):
    eps = spark.createDataFrame([(0, 0, 2, 0, 2, 3, 5), (0, 5, 7, 5, 7, 3, 9), (1, 0, 2, 0, 2, 3, 5), (1, 5, 7, 5, 7, 3, 5), (2, 0, 1, 0, 1, 2, 5)], "rec bigint, first_index bigint, last_index bigint, first_t bigint, last_t bigint, observed bigint, motion bigint")
    all_ = spark.createDataFrame([(k,) for k in range(4)], "rec bigint")
    got = {r["rec"]: (r["status"], r["first_index"]) for r in X.best_episode(all_, eps).collect()}
    assert got == {0: ("selected", 5), 1: ("selected", 0), 2: ("too_few_observed", 0), 3: ("no_episode", None)}


def test_statistics(spark):
    df = spark.createDataFrame([([5, 2**53 - 1, 0],), ([5, -(2**53 - 1), 1],)], "v array<bigint>")
    got = {r["feature"]: (r["n"], r["mean"], r["sd"]) for r in M.fit_statistics(df, "v").collect()}
    assert got == {0: (2, 5, 1_000_000), 1: (2, 0, 2**53 - 1), 2: (2, 1, 1)}


def test_no_viable_threshold(spark):
    curve = spark.createDataFrame([(0, 5, 1, 1.0), (50, 0, 0, 0.0)], "percent int, accepted bigint, errors bigint, coverage double")
    assert M.choose_threshold(curve).first()["status"] == "no_viable_operating_point"


def test_one_shuffle_by_entity(spark):
    df = spark.range(1000).select((F.col("id") % 10).alias("rec"), F.col("id").alias("i"), F.col("id").alias("t"), (F.col("id") % 3 > 0).alias("p"))
    plan = X.episodes(df, F.col("p"), X.GapPolicy())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_swapped_and_unsure_hands(spark):
    """rec 0 swaps over a gap, rec 1 does so without confidence, rec 2 keeps its hands, rec 3 only changes labels."""
    rows = []
    for rec in range(4):
        swapped, moved, last = rec in (0, 1, 3), rec in (0, 1), 400_000 if rec == 1 else 900_000
        rows += [(rec, 0, 0, True, True, 0.0, 1.0, "left", "right", 900_000), (rec, 1, 40_000, True, False, 0.0, None, "left", None, 900_000)]
        rows.append((rec, 2, 80_000, True, True, *((1.0, 0.0) if moved else (0.0, 1.0)), *(("right", "left") if swapped else ("left", "right")), last))
    df = spark.createDataFrame(rows[::-1], "rec bigint, i bigint, t bigint, p0 boolean, p1 boolean, x0 double, x1 double, l0 string, l1 string, c bigint").repartition(3)
    at = lambda x: (F.col(x), F.lit(0.0), F.lit(0.0))
    hands = {f"hand_{k}": X.Hand(F.col(f"p{k}"), F.col(f"l{k}"), F.col("c"), at(f"x{k}"), at(f"x{k}")) for k in (0, 1)}
    policy = X.GapPolicy()
    assert [tuple(r) for r in X.suspected_swaps(df, tuple(hands.values()), policy).collect()] == [(0, 0, 2)]
    gaps = X.decided_gaps(df, {"hand_0": F.col("p0"), "hand_1": F.col("p1")}, policy, hands=hands).orderBy("rec").collect()
    assert [(g["signal"], g["decision"], g["reasons"], g["swapped"]) for g in gaps] == [
        ("hand_1", "preserve_missing", ["identity_ambiguity"], True), ("hand_1", "preserve_missing", ["low_confidence"], False),
        ("hand_1", "interpolate_linear", ["eligible_short_internal_gap"], False), ("hand_1", "preserve_missing", ["identity_ambiguity"], False),
    ]


def test_thresholds_of_targets(spark):
    """0.29 * 100 is below 29 in floating point; class 2 isn't a target."""
    df = spark.createDataFrame([(0, 0, 0.29), (0, 1, 0.2), (1, 1, 0.5), (2, 0, 0.4), (2, 2, 0.1)], "label int, predicted int, confidence double")
    curve = M.risk_coverage(df, target=F.col("label") < 2, said_target=F.col("predicted") < 2)
    at = {r["percent"]: r.asDict() for r in curve.collect()}
    assert [at[29]["accepted"], at[30]["accepted"], at[29]["errors"], at[29]["correct_target_coverage"]] == [3, 2, 1, 2 / 3]
    assert [at[40]["false_acceptance"], at[41]["false_acceptance"], at[41]["abstention_rate"], at[0]["abstention_rate"]] == [0.5, 0.0, 1.0, 0.0]
    assert [M.choose_threshold(curve).first()[c] for c in ("status", "percent", "correct_target_coverage")] == ["selected", 41, 1 / 3]


def test_model_choice(spark):
    scores = spark.createDataFrame([(1.0, 0.5), (0.1, 0.5), (10.0, 0.4)], "c double, macro_f1 double")
    assert tuple(J.choose_model(scores).first()) == (0.1, 0.5)
    assert tuple(J.choose_model(scores.where("false")).first()) == (None, None)


def test_differences_too_large_for_64_bits_are_null(spark, tmp_path):
    from strandline.plans.sequence_queries import e8_differences

    rows = [(1, "2024-01-01 00:00:00", 7, "view", 0.0), (2, "2024-01-01 00:00:01", 7, "view", 500.0), (3, "2024-01-01 00:00:02", 7, "view", 0.0), (4, "2024-01-01 00:00:02.000001", 7, "view", 500.0)]
    spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string, value double").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    got = e8_differences(spark, str(tmp_path)).orderBy("i").select("velocity_q", "acceleration_q").collect()
    assert [tuple(r) for r in got] == [(None, None), (500_000_000_000_000, None), (-500_000_000_000_000, None), (None, None)]


def test_nearest_ranks_by_counts_of_values_are_those_of_a_sort(spark):
    rows = [(g, float(v)) for g, n in (("a", 1), ("b", 20), ("c", 333)) for v in (7919 * k % 41 for k in range(n))]
    values = {g: sorted(v for k, v in rows if k == g) for g in "abc"}
    df = spark.createDataFrame([*rows, ("b", None), ("d", None), (None, 5.0)], "g string, v double").repartition(3)
    got = {r["g"]: (r["p50"], r["p90"], r["p95"]) for r in M.nearest_rank(df, "v", (50, 90, 95), "g").collect()}
    assert got == {g: tuple(v[-(-p * len(v) // 100) - 1] for p in (50, 90, 95)) for g, v in values.items()} | {"d": (None,) * 3, None: (5.0,) * 3}
    assert [tuple(r) for r in M.nearest_rank(df.where("g = 'c'"), "v", (50, 95)).collect()] == [(values["c"][166], values["c"][316])]
    assert [tuple(r) for r in M.nearest_rank(df.where("g = 'd'"), "v", (50, 95)).collect()] == [(None, None)]


def test_nearest_ranks_hold_no_group_in_one_buffer(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").cast("double").alias("v"))
    plan = M.nearest_rank(df, "v", (50,), "g")._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "percentile" not in plan and "collect" not in plan


def test_sql_time_grid_joins_nothing(spark):
    from strandline.functions.sql import register_time_grid

    register_time_grid(spark)
    df = spark.sql("SELECT s.rec, g.grid_us FROM {s} s, LATERAL time_grid(s.span, 30, 1) g", s=spark.createDataFrame([(1, 50_000), (2, 33_333), (3, None), (4, 50_000)], "rec int, span bigint"))
    assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in df.collect()) == [(1, 0), (1, 33_333), (1, 50_000), (2, 0), (2, 33_333), (4, 0), (4, 33_333), (4, 50_000)]
