"""Landmark features against plain computations in three dimensions."""

import math

import pytest
from pyspark.sql import functions as F

from strandline.functions import scalars as S
from strandline.operators import features as X
from strandline.operators.sequences import GapPolicy

POINT = "struct<x: double, y: double, z: double>"
SIGNAL = f"struct<world: array<{POINT}>, image: array<struct<x: double, y: double>>, left: boolean>"
SCHEMA = f"rec bigint, i bigint, t bigint, invalid boolean, hand_0 {SIGNAL}, hand_1 {SIGNAL}, body {SIGNAL}"
BODY = (None, [(0.3, 0.5), (0.7, 0.5)], None)


def hand(shift=0.0, left=True):
    world = [(math.cos(k) + shift * k, math.sin(2 * k), 0.1 * k) for k in range(21)]
    return world, [(x / 4 + 0.5, y / 4 + 0.5) for x, y, _ in world], left


def local(points, left, mirrored):
    points = [(-x if mirrored else x, y, z) for x, y, z in points]
    truly_left = left if mirrored else not left
    size = math.dist(points[0], points[9])
    return [((-1 if truly_left else 1) * (p[0] - points[0][0]) / size, (p[1] - points[0][1]) / size, (p[2] - points[0][2]) / size) for p in points]


@pytest.mark.parametrize("left", [True, False])
@pytest.mark.parametrize("mirrored", [True, False])
def test_hand_local_corrects_mirror_and_handedness(spark, left, mirrored):
    world = hand()[0]
    df = spark.createDataFrame([(world,)], f"p array<{POINT}>")
    got = df.select(S.hand_local(F.col("p"), F.lit(left), F.lit(mirrored)).alias("p")).first()["p"]
    want = local(world, left, mirrored)
    assert all(math.isclose(a, b, abs_tol=1e-12) for g, w in zip(got, want) for a, b in zip(g, w))


def test_a_hand_is_scaled_once_and_not_for_each_coordinate(spark):
    df = spark.createDataFrame([(hand()[0],)], f"p array<{POINT}>")
    plan = df.select(S.hand_local(F.col("p"), F.lit(True), F.lit(False)).alias("local"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("SQRT(") == 1


def test_hand_without_scale_and_flat_angle_are_null(spark):
    df = spark.createDataFrame([([(1.0, 2.0, 3.0)] * 21,), (None,)], f"p array<{POINT}>")
    local_ = S.hand_local(F.col("p"), F.lit(True), F.lit(False))
    at = lambda k: F.get("p", F.lit(k))
    assert [tuple(r) for r in df.select(local_, S.angle(at(0), at(1), at(2))).collect()] == [(None, None)] * 2


def test_angle_and_tips_use_depth(spark):
    points = [(0.0, 0.0, 0.0)] * 21
    points[1], points[2], points[4] = (0.0, 0.0, 1.0), (0.0, 1.0, 1.0), (0.0, 3.0, 4.0)
    df = spark.createDataFrame([(points,)], f"p array<{POINT}>")
    at = lambda k: F.get("p", F.lit(k))
    angle, tip = df.select(S.angle(at(0), at(1), at(2)), F.get(S.tip_distances(F.col("p")), F.lit(0))).first()
    assert math.isclose(angle, math.pi / 2) and tip == 5.0


def made(spark, rows, plan, mirrored=None):
    return X.derive_features(spark.createDataFrame(rows, SCHEMA), GapPolicy(), plan, mirrored)


@pytest.mark.parametrize(
    "plan,width",
    [(X.FeaturePlan("hand_local"), 126), (X.FeaturePlan("body_relative"), 8), (X.FeaturePlan(), 134), (X.FeaturePlan(angles=True, tips=True, differences=2), 3 * 134 + 20), (X.FeaturePlan("body_relative", differences=1), 16)],
)
def test_shapes(spark, plan, width):
    rows = [(0, i, 33_333 * i, False, hand(), hand(0.1, False), BODY) for i in range(3)]
    row = made(spark, rows, plan).first()
    assert plan.width == width
    for name in ("values_q", "valid_mask", "observed_mask", "interpolated_mask"):
        assert [len(x) for x in row[name]] == [width] * 64
    assert row["padding_mask"] == [False] * 3 + [True] * 61


def test_values_and_velocities_of_positions(spark):
    rows = [(0, i, t, False, hand(0.1 * i), None, BODY) for i, t in ((0, 0), (1, 33_333), (2, 66_667))]
    row = made(spark, rows, X.FeaturePlan("hand_local", tips=True, differences=1)).first()
    times, values, valid = row["timestamps_us"], row["values_q"], row["valid_mask"]
    assert times[:3] == [0, 33_333, 66_667]
    per = [[v for p in local(hand(0.1 * i)[0], True, False) for v in p] for i in range(3)]
    for i in range(3):
        assert all(abs(a - b * 1e6) <= 0.5 + 1e-6 for a, b in zip(values[i], per[i]))
        assert valid[i][:63] == [True] * 63 and valid[i][63:126] == [False] * 63
        assert valid[i][126:136] == [True] * 5 + [False] * 5
        assert valid[i][136:199] == [i > 0] * 63 and valid[i][199:] == [False] * 63
    seconds = (times[1] - times[0]) / 1e6
    assert all(abs(a - (y - x) / seconds * 1e6) <= 0.5 + 1e-3 for a, x, y in zip(values[1][136:199], per[0], per[1]))


def test_a_change_of_handedness_is_not_interpolated(spark):
    rows = [(rec, i, 50_000 * i, False, hand(0.0, i == 0 or rec == 1), None, BODY) for rec in (0, 1) for i in range(2)]
    got = {r["rec"]: r for r in made(spark, rows, X.FeaturePlan("hand_local")).collect()}
    assert got[0]["timestamps_us"][1] == got[1]["timestamps_us"][1] == 33_333
    assert not any(got[0]["valid_mask"][1]) and got[1]["interpolated_mask"][1] == [True] * 63 + [False] * 63
    assert got[0]["hand_present_mask"][1] == [False, False]


def test_body_needs_width_and_the_mirror_turns_it(spark):
    narrow = (None, [(0.5, 0.5), (0.5, 0.5)], None)
    rows = [(0, 0, 0, False, hand(), None, BODY), (1, 0, 0, False, hand(), None, narrow), (2, 0, 0, False, hand(), None, None), (3, 0, 0, False, hand(), None, BODY)]
    got = {r["rec"]: r for r in made(spark, rows, X.FeaturePlan("body_relative"), F.col("rec") == 3).collect()}
    assert [got[k]["body_available_mask"][0] for k in range(4)] == [True, False, False, True]
    assert got[1]["valid_mask"][0] == got[2]["valid_mask"][0] == [False] * 8
    x, y = hand()[1][0]
    assert abs(got[0]["values_q"][0][0] - (x - 0.5) / 0.4 * 1e6) <= 0.51 and abs(got[0]["values_q"][0][1] - (y - 0.5) / 0.4 * 1e6) <= 0.51
    assert abs(got[3]["values_q"][0][0] + (x - 0.5) / 0.4 * 1e6) <= 0.51


def test_features_of_a_long_recording_bring_only_picked_frames_together(spark):
    rows = [(0, i, 33_333 * i, False, hand(0.1 * i), None, BODY) for i in range(200)]
    df = X.derive_features(spark.createDataFrame(rows, SCHEMA), GapPolicy(), X.FeaturePlan("hand_local", differences=1))
    row = df.first()
    assert row["source_grid_frame_count"] == 200 and not any(row["padding_mask"])
    assert [sum(v) for v in row["valid_mask"]] == [63] + [126] * 63
    assert row["timestamps_us"][0] == 0 and row["timestamps_us"][-1] == 33_333 * 199


def test_only_landmarks_of_the_chosen_are_sorted(spark):
    from strandline.operators.corpus import corpus_features

    chosen = spark.createDataFrame([(1, 0, 1)], "rec bigint, first_index bigint, last_index bigint").withColumn("first_t", F.lit(0).cast("bigint"))
    marks = spark.createDataFrame([(r, i, 10 * i, 100 * r) for r in range(5) for i in range(4)], "rec bigint, i bigint, t bigint, x int")
    seen = []
    df = corpus_features(chosen, marks, lambda cut: seen.append(cut._jdf.queryExecution().optimizedPlan().toString()) or cut.groupBy("rec").agg(F.sum("x").alias("x")))
    assert [(r["rec"], r["x"]) for r in df.collect()] == [(1, 200)]
    assert "LeftSemi" in seen[0] and seen[0].rindex("LeftSemi") > seen[0].rindex("Window")


def test_resampled_frames_are_shuffled_once_by_recording(spark):
    import re

    rows = [(0, i, 33_333 * i, False, hand(), None if i == 1 else hand(0.1, False), BODY) for i in range(4)]
    df = X.resample(spark.createDataFrame(rows, SCHEMA), GapPolicy()).where("hand_0 IS NOT NULL")
    plan = df._jdf.queryExecution().executedPlan().toString()
    wide = [x for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)]
    # frames for the gaps and frames with marks by recording, runs by signal, marks by first frame: none by grid time
    assert sum(x.startswith("rec") and "," in x and "signal" not in x and "i#" not in x and not re.fullmatch(r"rec#\d+L, \d+", x) for x in wide) == 0 and len(wide) <= 6
    got = {r["t"]: (r["hand_1_evidence"], r["hand_1_cut"], r["hand_0_evidence"]) for r in df.collect()}
    assert got == {0: ("observed", False, "observed"), 33_333: ("interpolated", False, "observed"), 66_667: ("interpolated", False, "interpolated"), 99_999: ("observed", False, "observed")}
