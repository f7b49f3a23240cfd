"""Consent logs: late entries, ties, completeness, and reasons in their order."""

from datetime import datetime

import pytest

from strandline.operators import consent as O

D = lambda day: datetime(2024, 1, day)
LOG, MARKS = "receipt_id int, event string, occurred_at timestamp, recorded_at timestamp", "receipt_id int, complete_through timestamp, recorded_at timestamp"


@pytest.fixture(scope="module")
def log(spark):
    rows = [(1, "granted", D(1), D(1)), (1, "ended", D(10), D(11)), (1, "ended", D(3), D(20)), (2, "granted", D(1), D(1)), (2, "ended", D(1), D(1)), (3, "granted", D(5), D(5)), (3, "ended", D(8), D(30))]
    marks = [(1, D(9), D(9)), (1, D(15), D(15)), (2, D(30), D(30)), (3, D(7), D(9))]
    return spark.createDataFrame(rows, LOG), spark.createDataFrame(marks, MARKS)


def states(spark, log, asked):
    df = spark.createDataFrame(asked, "k int, receipt_id int, at timestamp")
    return {r["k"]: r["state"] for r in O.states_at(df, *log, "at", "k").collect()}


def test_states_as_of_a_time(spark, log):
    asked = [(1, 1, D(4)), (2, 1, D(10)), (3, 1, D(16)), (4, 2, D(1)), (5, 3, D(4)), (6, 3, D(6)), (7, 3, D(8)), (8, 9, D(1)), (9, 1, D(9))]
    assert states(spark, log, asked) == {1: "granted", 2: "ended", 3: "unknown", 4: "ended", 5: "none", 6: "granted", 7: "unknown", 8: "unknown", 9: "granted"}


def test_late_entries_flip_no_answer_before_the_mark(spark, log):
    late = [tuple(r)[:3] for r in O.judged_log(*log).where("late").collect()]
    assert late == [(1, "ended", D(3))]
    asked = [(k, 1, D(k)) for k in range(1, 16)]
    before = states(spark, log, asked)
    more = log[0].union(spark.createDataFrame([(1, "ended", D(2), D(25)), (1, "granted", D(12), D(25))], LOG))
    assert states(spark, (more, log[1]), asked) == before


def test_reasons(spark):
    receipts = spark.createDataFrame([(1, 1, "p", "s", "t", D(2), D(20), True, True), (2, 2, "p", "s", "t", D(2), None, False, True)], "receipt_id int, participant_id int, purpose_id string, study_id string, taxonomy string, granted_at timestamp, valid_until timestamp, train boolean, future_research boolean")
    scope = {r["receipt_id"]: r["h"] for r in receipts.withColumn("h", O.scope_hash(("train", "future_research"))).collect()}
    grants = spark.createDataFrame([(10, 1, 1, "p", "s", "t", scope[1], D(3), D(4), True, True), (11, 1, 1, "p", "s", "t", scope[1], D(3), D(4), True, False), (12, 2, 2, "p", "s", "t", "old", D(1), D(4), True, None), (13, 9, 1, "p", "s", "t", "x", D(3), D(4), True, True)], "grant_id int, receipt_id int, participant_id int, purpose_id string, study_id string, taxonomy string, receipt_scope_sha256 string, issued_at timestamp, captured_at timestamp, train boolean, future_research boolean")
    log = spark.createDataFrame([(k, "granted", D(2), D(2)) for k in (1, 2)] + [(1, "ended", D(15), D(15))], LOG)
    marks = spark.createDataFrame([(1, D(28), D(28)), (2, D(28), D(28))], MARKS)
    asked = [(1, 10, "train", D(5), "p", "s"), (2, 10, "train", D(5), "q", "s"), (3, 10, "train", D(5), "p", "z"), (4, 11, "train", D(5), "p", "z"), (5, 10, "train", D(3), "p", "s"), (6, 12, "train", D(5), "p", "s"), (7, 10, "publish", D(5), "p", "s"), (8, 10, "train", D(15), "p", "s"), (9, 10, "train", D(20), "p", "s"), (10, 99, "train", D(5), "p", "s"), (11, 10, "train", D(29), "p", "s"), (12, 13, "train", D(5), "p", "s")]
    requests = spark.createDataFrame(asked, "request_id int, grant_id int, permission string, at timestamp, purpose_id string, study_id string")
    got = {r["request_id"]: (r["authorized"], r["reason"]) for r in O.authorizations(requests, grants, receipts, log, marks, ("train", "future_research")).collect()}
    no = lambda reason: (False, reason)
    assert got == {1: (True, "granted"), 2: no("other_purpose"), 3: (True, "granted"), 4: no("other_study"), 5: no("before_capture"), 6: no("not_permitted"), 7: no("not_permitted"), 8: no("not_granted"), 9: no("outside_window"), 10: no("unknown_grant"), 11: (None, "log_incomplete"), 12: no("unknown_grant")}
    found = sorted(tuple(r) for r in O.receipt_grant_violations(grants, receipts, log, marks, ("train", "future_research")).collect())
    assert found == [("issued_early", 12), ("receipt_missing", 13), ("scope_hash_differs", 12), ("train_widened", 12)]
