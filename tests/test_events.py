"""The detector on hand-made streams, in batch and as a stream, and the tracker."""

import numpy as np
import pandas as pd
import pytest

from strandline.operators import events as E
from strandline.operators import matching as T
from strandline.streaming import live


def stream(parts):
    """Observations 33,333 µs apart from (count, hand, motion)."""
    rows, t = [], 0
    for count, hand, motion in parts:
        for _ in range(count):
            rows.append((t, hand, True, motion))
            t += 33_333
    return pd.DataFrame(rows, columns=["t", "hand_present", "quality_ok", "motion_q"])


def events(parts):
    state = E.State()
    found = list(E.run(stream(parts), state, E.Limits()))
    last = E.finish(state, E.Limits())
    return [e[4] for e in [*found, *([last] if last else [])]], found


def test_settled_gap_and_end():
    assert events([(5, True, 0), (20, True, 900_000), (20, True, 0)])[0] == ["settled"]
    assert events([(20, True, 900_000), (5, False, 0)])[0] == ["signal_gap"]
    assert events([(20, True, 900_000)])[0] == ["stream_end"]
    assert events([(3, True, 900_000)])[0] == []  # still arming
    assert events([(200, True, 900_000)])[0][0] == "max_duration"


def test_short_gap_is_bridged():
    assert events([(10, True, 900_000), (2, False, 0), (10, True, 900_000)])[0] == ["stream_end"]


def test_pre_roll_begins_before_motion():
    _, found = events([(10, True, 0), (20, True, 900_000), (20, True, 0)])
    assert found[0][0] == 7 and found[0][2] == 7 * 33_333  # frame 10 smooths to 450,000; 99,999 µs before it is frame 7


def test_time_must_rise():
    state = E.State()
    E.step(state, E.Limits(), 5, True, True, 0)
    with pytest.raises(ValueError):
        E.step(state, E.Limits(), 5, True, True, 0)


def test_state_survives_as_text():
    whole, cut = E.State(), E.State()
    rows = stream([(5, True, 0), (20, True, 900_000), (20, True, 0)])
    a = list(E.run(rows, whole, E.Limits()))
    b = []
    for k in range(len(rows)):
        b += list(E.run(rows.iloc[k : k + 1], cut, E.Limits()))
        cut = E.State.of(cut.text())
    assert a == b


def test_tracking_keeps_crossing_hands_apart():
    held = E.Slots(E.Tracking())

    def place(*xs, labels=None):
        return held.assign(np.array([[x, 0.5, 0, x, 0.5, 0] for x in xs]).reshape(-1, 6), labels or [None] * len(xs), list(np.argsort(np.argsort(xs))))

    assert place(0.8, 0.2) == [1, 0]
    assert place(0.25, 0.75) == [0, 1]
    assert place() == []
    assert place(0.7) == [1]


def test_tracking_costs_wrist_and_palm_squared():
    held = E.Slots(E.Tracking())
    held.assign(np.array([[0.1, 0.2, 0.3, 0.4, 0.5, 0.6]]), ["left"], [0])
    space, total = held.costs(np.array([[0.2, 0.2, 0.1, 0.4, 0.8, 0.6], [0.1, 0.2, 0.3, 0.4, 0.5, 0.6]]), ["right", None])
    assert np.allclose(space[0], [0.01 + 0.04 + 0.09, 0]) and np.allclose(total[0], [0.24, 0]) and np.isinf(space[1]).all()


def test_tracking_of_ties_falls_back_to_place(spark):
    held = E.Slots(E.Tracking())
    at = lambda *xs: np.array([[x, 0, 0, x, 0, 0] for x in xs])
    assert held.assign(at(0.4, 0.6), [None, None], [0, 1]) == [0, 1]
    assert held.assign(at(0.5, 0.5), [None, None], [0, 1]) == [0, 1]  # both ways cost the same
    assert held.assign(at(0.0), [None], [0]) in ([0], [1])
    rows = [(1, i, k, x, 0.0, 0.0, x, 0.0, 0.0, None) for i, xs in enumerate([(0.2, 0.8), (0.75,), (), (0.3, 0.7), (0.65, 0.35)]) for k, x in enumerate(xs)]
    got = E.track_identities(spark.createDataFrame(rows, "rec int, i int, k int, x double, y double, z double, palm_x double, palm_y double, palm_z double, label string")).collect()
    assert {(r["i"], r["k"]): r["slot"] for r in got} == {(0, 0): 0, (0, 1): 1, (1, 0): 1, (3, 0): 0, (3, 1): 1, (4, 0): 1, (4, 1): 0}


def test_the_stream_of_46_observations():
    """Fixed values, in milliseconds: when the hand is there, moves, and can't be judged; two events and ten changes of state follow."""
    times = [*range(0, 1000, 50), 975, *range(1000, 2250, 50)]
    moving = {*range(350, 650, 50), *range(850, 1000, 50), 1050, 1100, *range(1800, 2050, 50)}
    unclear = {975, 1000, 2050, 2100, 2150}
    state, limits = E.State(), E.Limits()
    found, modes = [], ["inactive"]
    for t in times:
        if event := E.step(state, limits, t * 1000, 150 <= t <= 2150, t not in unclear, 1_000_000 if t in moving else 0):
            found.append(event)
        modes.append(state.mode)
    assert len(times) == 46 and E.finish(state, limits) is None
    assert [e[2:] for e in found] == [(250_000, 1_250_000, "settled"), (1_750_000, 2_000_000, "signal_gap")]
    changes = [(k, after) for k, (before, after) in enumerate(zip(modes, modes[1:])) if before != after]
    assert changes == list(zip([7, 9, 16, 17, 27, 31, 35, 37, 39, 44], ["arming", "recording", "finalizing", "recording", "finalizing", "cooldown", "inactive", "arming", "recording", "cooldown"]))


def test_greedy_match_takes_each_decision_once(spark):
    t = spark.createDataFrame([(0, 1, 0, 10), (0, 2, 5, 15)], "session bigint, truth_id bigint, start_us bigint, end_us bigint")
    d = spark.createDataFrame([(0, 7, 4, 14), (0, 8, 0, 4)], "session bigint, decision_id bigint, start_us bigint, end_us bigint")
    got = sorted(tuple(r) for r in T.match_intervals(t, d, least_iou_ppm=1).collect())
    assert got == [(0, 1, 7, 428_571)]


def test_split_attempts_within_a_batch(spark):
    rows = spark.createDataFrame([(1, "a", "s1"), (2, "b", "s1"), (3, "c", "s3")], "k bigint, c string, s string")
    ledger = spark.createDataFrame([(3, "z", "s9")], "k bigint, c string, s string")
    got = {r["k"]: r["status"] for r in live.split_attempts(rows, ledger, "k", "c", "s").collect()}
    assert got == {1: "new", 2: "conflict", 3: "conflict"}
