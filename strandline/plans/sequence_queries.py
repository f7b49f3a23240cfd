"""Queries of the sequence operators over the events table, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import quality as Q
from ..operators import sequences as X
from .bindings import DECIDED, FRAMES, GAPS, HOUR, POLICY, STEPS, SWAPS, frames, hands, palm_q, palm_q_sql, point, point_sql

def _signals():
    return {"hand_0": F.col("h0"), "hand_1": F.col("h1")}


def e1_time_steps(spark: SparkSession, sf: str) -> DataFrame:
    return X.time_steps(frames(spark, sf)).select("rec", "i", "t", "step")


def d20_median_steps(spark: SparkSession, sf: str) -> DataFrame:
    return X.median_steps(frames(spark, sf))


def e2_timestamp_discontinuities(spark: SparkSession, sf: str) -> DataFrame:
    return X.timestamp_discontinuities(frames(spark, sf), POLICY).select("rec", "i", "step", "median_step")


def _slots():
    return {f"hand_{h}": (F.col(f"h{h}"), tuple(point(k=30 * h + k, axis=x) for k in (0, 9) for x in (0, 1))) for h in (0, 1)}


def e3_motion_discontinuities(spark: SparkSession, sf: str) -> DataFrame:
    return X.motion_discontinuities(frames(spark, sf), _slots(), 1 / 36_000).select("rec", "i", F.round("speed", 9).alias("speed"))


def _speed(a: int, b: int, h: str) -> str:
    terms = " + ".join(f"power({point_sql(k, x)} - lag({point_sql(k, x)}) OVER w, 2)" for k in (a, b) for x in (0, 1))
    return f"CASE WHEN {h} AND lag({h}) OVER w AND step > 0 THEN sqrt({terms}) / (step / 1000000.0) END"


E3 = f"""WITH {STEPS}, v AS (SELECT rec, i, greatest({_speed(0, 9, 'h0')}, {_speed(30, 39, 'h1')}) AS speed FROM steps WINDOW w AS (PARTITION BY rec ORDER BY i))
SELECT rec, i, round(speed, 9) AS speed FROM v WHERE speed > 1 / 36000.0"""


def e4_missing_intervals(spark: SparkSession, sf: str) -> DataFrame:
    return X.missing_intervals(frames(spark, sf), _signals(), F.col("invalid"))


def _decided(spark: SparkSession, sf: str) -> DataFrame:
    return X.decided_gaps(frames(spark, sf), _signals(), POLICY, F.col("invalid"), hands())


def e5_gap_decisions(spark: SparkSession, sf: str) -> DataFrame:
    return _decided(spark, sf).select("rec", "signal", "first_index", "last_index", "missing", "duration", "decision", F.array_join("reasons", ",").alias("reasons"))


def c9_gap_barriers(spark: SparkSession, sf: str) -> DataFrame:
    return _decided(spark, sf).groupBy("rec").agg(F.count("*").alias("gaps"), F.count_if("jumped").alias("jumped"), F.count_if("has_invalid").alias("with_invalid"), F.count_if("swapped").alias("swapped"), F.count_if("ambiguous").alias("ambiguous"), F.count_if("unsure").alias("unsure"))


def e6_suspected_swaps(spark: SparkSession, sf: str) -> DataFrame:
    return X.suspected_swaps(frames(spark, sf), tuple(hands().values()), POLICY)


E6 = f"WITH {FRAMES}, {SWAPS} SELECT * FROM swaps"


def _episodes(spark: SparkSession, sf: str) -> DataFrame:
    return X.episodes(frames(spark, sf), F.col("h0"), POLICY, "q")


def e7_episodes(spark: SparkSession, sf: str) -> DataFrame:
    return _episodes(spark, sf).drop("episode")


EPISODES = f"""{FRAMES},
seen AS (SELECT *, max(CASE WHEN h0 THEN t END) OVER b AS lt, max(CASE WHEN h0 THEN i END) OVER b AS li, min(CASE WHEN h0 THEN t END) OVER a AS rt, min(CASE WHEN h0 THEN i END) OVER a AS ri FROM frames
  WINDOW b AS (PARTITION BY rec ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY rec ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
bridged AS (SELECT *, h0 OR coalesce(ri - li - 1 <= 2 AND rt - lt <= {36 * HOUR}, FALSE) AS on_ FROM seen),
numbered AS (SELECT *, i - row_number() OVER (PARTITION BY rec ORDER BY i) AS episode FROM bridged WHERE on_),
episodes AS (SELECT rec, min(i) AS first_index, max(i) AS last_index, min(t) AS first_t, max(t) AS last_t, count(*) FILTER (h0) AS observed, CAST(sum(CASE WHEN h0 THEN q ELSE NULL END) AS BIGINT) AS motion FROM numbered GROUP BY rec, episode)"""
BEST = f"""{EPISODES},
ranked AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY observed DESC, motion DESC, last_t - first_t DESC, first_index) AS k FROM episodes),
best AS (SELECT r.rec, CASE WHEN e.rec IS NULL THEN 'no_episode' WHEN e.observed < 3 THEN 'too_few_observed' ELSE 'selected' END AS status, first_index, last_index, first_t, last_t, observed, motion
  FROM (SELECT DISTINCT rec FROM frames) r LEFT JOIN ranked e ON e.rec = r.rec AND e.k = 1)"""


def f1_best_episodes(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    return X.best_episode(f, X.episodes(f, F.col("h0"), POLICY, "q"))


def f2_sliced_frames(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    best = X.best_episode(f, X.episodes(f, F.col("h0"), POLICY, "q")).where("status = 'selected'")
    return X.monotone_ms(X.slice_and_rebase(f, best)).select("rec", "i", "t", "task_ms", "event_id")


F2 = f"""WITH RECURSIVE {BEST}, cut AS (SELECT f.rec, f.i - b.first_index AS i, f.t - b.first_t AS t, event_id FROM frames f JOIN best b ON f.rec = b.rec AND b.status = 'selected' AND f.i BETWEEN b.first_index AND b.last_index)
SELECT rec, i, t, i + max(t // 1000 - i) OVER (PARTITION BY rec ORDER BY i) AS task_ms, event_id FROM cut"""


def e8_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Differences between observed rows of a hand, across gaps that may be filled but not across preserved ones. A quantized difference beyond 64 bits is NULL: it has no value there (its SQL raises an error)."""
    kept = _decided(spark, sf).where("signal = 'hand_0'")
    f = X.with_barrier(frames(spark, sf).where("h0").select("rec", "i", "t", "q"), kept)
    first = X.differences(f, "q", F.col("barrier"))
    both = X.differences(first, "velocity", F.col("barrier"), out="acceleration")
    return both.select("rec", "i", "barrier", F.round(F.col("velocity") * 1e6).try_cast("bigint").alias("velocity_q"), F.round(F.col("acceleration") * 1e12).try_cast("bigint").alias("acceleration_q"))


E8 = f"""WITH {DECIDED}, o AS (SELECT rec, i, t, q, lag(t) OVER w AS before, (t - lag(t) OVER w) / 1000000.0::DOUBLE AS s FROM frames WHERE h0 WINDOW w AS (PARTITION BY rec ORDER BY i)),
a AS (SELECT *, EXISTS (SELECT 1 FROM decided d WHERE d.rec = o.rec AND signal = 'hand_0' AND decision = 'preserve_missing' AND d.first_t <= o.t AND d.last_t >= o.before) AS barrier FROM o),
b AS (SELECT *, CASE WHEN s > 0 AND NOT barrier THEN (q - lag(q) OVER (PARTITION BY rec ORDER BY i)) / s END AS velocity FROM a),
c AS (SELECT *, CASE WHEN s > 0 AND NOT barrier THEN (velocity - lag(velocity) OVER (PARTITION BY rec ORDER BY i)) / s END AS acceleration FROM b)
SELECT rec, i, barrier, CAST(round(velocity * 1e6) AS BIGINT) AS velocity_q, CAST(round(acceleration * 1e12) AS BIGINT) AS acceleration_q FROM c"""


def e10_smoothed(spark: SparkSession, sf: str) -> DataFrame:
    return X.smooth(frames(spark, sf), "q", F.col("h0"))


E10 = f"""WITH RECURSIVE {FRAMES}, u AS (SELECT rec, i, q, row_number() OVER (PARTITION BY rec ORDER BY i) AS k FROM frames WHERE h0),
r AS (SELECT rec, i, k, q AS smoothed FROM u WHERE k = 1 UNION ALL SELECT u.rec, u.i, u.k, (500000 * u.q + 500000 * r.smoothed + 500000) // 1000000 FROM r JOIN u ON u.rec = r.rec AND u.k = r.k + 1)
SELECT rec, i, smoothed FROM r"""


def e11_monotone_ms(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf).withColumn("t", S.div(F.col("t"), F.lit(50_000_000)))
    return X.monotone_ms(f).select("rec", "i", "task_ms")


E11 = f"""WITH RECURSIVE {FRAMES}, s AS (SELECT rec, i, (t // 50000000) // 1000 AS m FROM frames),
r AS (SELECT rec, i, m AS task_ms FROM s WHERE i = 0 UNION ALL SELECT s.rec, s.i, greatest(s.m, r.task_ms + 1) FROM r JOIN s ON s.rec = r.rec AND s.i = r.i + 1) SELECT rec, i, task_ms FROM r"""


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    span = frames(spark, sf).groupBy("rec").agg(F.max("t").alias("span"))
    return span.select("rec", F.explode(F.transform(F.sequence(F.lit(0), F.lit(40)), lambda k: S.div(F.col("span") * k, F.lit(40)))).alias("t")).distinct()


GRID = """spans AS (SELECT rec, max(t) AS span FROM frames GROUP BY rec), grid AS (SELECT DISTINCT rec, span * k // 40 AS t FROM spans, generate_series(0, 40) g(k))"""


def c7_bracket_join(spark: SparkSession, sf: str) -> DataFrame:
    found = X.bracket_join(_grid(spark, sf), frames(spark, sf).where("h0"), "q")
    return found.withColumn("value_q", F.round(S.lerp("left_v", "right_v", "left_t", "right_t", "t")).cast("bigint"))


C7 = f"""WITH {FRAMES}, {GRID}, s AS (SELECT rec, t, q FROM frames WHERE h0)
SELECT g.rec, g.t, l.t AS left_t, l.q AS left_v, r.t AS right_t, r.q AS right_v,
  CAST(round(CASE WHEN r.t > l.t THEN l.q + (r.q - l.q) * ((g.t - l.t)::DOUBLE / (r.t - l.t)) WHEN l.t = g.t AND r.t = g.t THEN l.q::DOUBLE END) AS BIGINT) AS value_q
FROM grid g ASOF LEFT JOIN s l ON g.rec = l.rec AND g.t >= l.t ASOF LEFT JOIN s r ON g.rec = r.rec AND g.t <= r.t"""


def c8_gap_at(spark: SparkSession, sf: str) -> DataFrame:
    approved = _decided(spark, sf).where("decision = 'interpolate_linear' AND signal = 'hand_0'")
    return X.gap_at(_grid(spark, sf), approved)


C8 = f"""WITH {DECIDED}, {GRID}, a AS (SELECT g.rec, g.t, min(struct_pack(l := d.left_t, r := d.right_t)) AS x FROM grid g LEFT JOIN decided d
  ON d.rec = g.rec AND d.signal = 'hand_0' AND d.decision = 'interpolate_linear' AND g.t > d.left_t AND g.t < d.right_t GROUP BY g.rec, g.t) SELECT rec, t, x.l AS gap_left, x.r AS gap_right FROM a"""


def h13_time_grid(spark: SparkSession, sf: str) -> DataFrame:
    """Seconds of a recording stand for its microseconds."""
    span = frames(spark, sf).groupBy("rec").agg(S.div(F.max("t"), F.lit(1_000_000)).alias("span"))
    return span.select("rec", F.posexplode(S.grid_times("span")).alias("k", "grid_us"))


H13 = f"""WITH {FRAMES}, s AS (SELECT rec, max(t) // 1000000 AS span FROM frames GROUP BY rec),
n AS (SELECT rec, span, (2 * k * 1000000 + 30) // 60 AS g FROM (SELECT rec, span, unnest(range(0, span * 30 // 1000000 + 1)) AS k FROM s) WHERE (2 * k * 1000000 + 30) // 60 <= span), a AS (SELECT rec, g FROM n UNION SELECT rec, span FROM s)
SELECT rec, CAST(row_number() OVER (PARTITION BY rec ORDER BY g) - 1 AS INTEGER) AS k, g AS grid_us FROM a"""


def f5_uniform_selection(spark: SparkSession, sf: str) -> DataFrame:
    n = frames(spark, sf).groupBy("rec").agg(F.count("*").alias("n"))
    return n.select("rec", "n", F.posexplode(S.uniform_indices("n", 64)).alias("k", "picked"))


F5 = f"""WITH {FRAMES}, c AS (SELECT rec, count(*) AS n FROM frames GROUP BY rec)
SELECT rec, n, CAST(k AS INTEGER) AS k, CASE WHEN n <= 64 THEN k ELSE (2 * k * (n - 1) + 63) // 126 END AS picked FROM c, generate_series(0, 63) x(k) WHERE k < n"""


def h12_padded(spark: SparkSession, sf: str) -> DataFrame:
    """64 values of each whole recording: those at the uniform indices, padded where it has fewer frames."""
    seq = frames(spark, sf).groupBy("rec").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias("v"))
    padded = seq.select("rec", S.fixed_length(F.col("v"), 64, F.lit(0).cast("bigint")).alias("p"), F.size("v").alias("n"))
    return padded.select("rec", F.col("n").cast("bigint").alias("n"), F.posexplode("p").alias("k", "v"))


H12 = f"""WITH {FRAMES}, n AS (SELECT rec, count(*) AS n FROM frames GROUP BY rec), g AS (SELECT rec, n, k, CASE WHEN n <= 64 THEN k ELSE (2 * k * (n - 1) + 63) // 126 END AS picked FROM n CROSS JOIN generate_series(0, 63) x(k))
SELECT g.rec, n, CAST(k AS INTEGER) AS k, coalesce(q, 0) AS v FROM g LEFT JOIN frames f ON f.rec = g.rec AND f.i = picked"""


def b5_observation_counts(spark: SparkSession, sf: str) -> DataFrame:
    return Q.observation_counts(frames(spark, sf), {"hand_0": F.col("h0"), "hand_1": F.col("h1")})


B5 = f"""WITH {FRAMES} SELECT rec, count(*) AS frames, count(*) FILTER (NOT invalid) AS valid, count(*) FILTER (invalid) AS invalid, count(*) FILTER (h0::INT + h1::INT = 0) AS with_0, count(*) FILTER (h0::INT + h1::INT = 1) AS with_1,
  count(*) FILTER (h0::INT + h1::INT = 2) AS with_2, count(*) FILTER (h0) AS seen_hand_0, count(*) FILTER (h1) AS seen_hand_1 FROM frames GROUP BY rec"""


def quality_of(f: DataFrame) -> DataFrame:
    e = F.col("event_id")
    anchors = {name: (~F.col("invalid") & (e % (5 + k) != 0), e * (17 + k) % 1000 * 1000) for k, name in enumerate(("nose", "left_shoulder", "right_shoulder"))}
    reasons = {"source": F.col("invalid") & (e % 2 == 0), "task": F.col("invalid") & (e % 2 != 0)}
    found = Q.quality_metrics(f, _signals(), POLICY, F.when(F.col("rec") % 2 == 0, 2).otherwise(1), hands=hands(), reasons=reasons, anchors=anchors, least_score_ppm=300_000, motion=(_slots(), 1 / 36_000))
    return found.withColumns({c: F.array_join(F.transform(c, lambda n: n.cast("string")), ",") for c in ("pose_seen", "pose_ppm")})


def d1_quality_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return quality_of(frames(spark, sf))


_ANCHORS = [(f"(NOT invalid AND event_id % {5 + k} <> 0)", f"(event_id * {17 + k} % 1000 * 1000 < 300000)") for k in range(3)]
METRICS = f"""{DECIDED}, v AS (SELECT rec, greatest({_speed(0, 9, 'h0')}, {_speed(30, 39, 'h1')}) AS speed FROM steps WINDOW w AS (PARTITION BY rec ORDER BY i)),
g AS (SELECT rec, count(*) AS gaps, count(*) FILTER (decision = 'interpolate_linear') AS filled, max(missing) FILTER (decision <> 'interpolate_linear' AND boundary = 'internal') AS longest_open, max(duration) FILTER (decision <> 'interpolate_linear' AND boundary = 'internal') AS longest_open_us FROM decided GROUP BY rec),
j AS (SELECT rec, count(*) AS jumps FROM jumps GROUP BY rec),
st AS (SELECT rec, count(step) AS steps, max(step) AS longest_step FROM steps GROUP BY rec),
mj AS (SELECT rec, count(*) FILTER (speed > 1 / 36000.0) AS motion_jumps FROM v GROUP BY rec), sw AS (SELECT rec, count(*) AS swaps FROM swaps GROUP BY rec),
base AS (SELECT rec, count(*) AS n, count(*) FILTER (invalid) AS bad, count(*) FILTER (invalid AND event_id % 2 = 0) AS invalid_source, count(*) FILTER (invalid AND event_id % 2 <> 0) AS invalid_task,
  sum(least(h0::INT + h1::INT, CASE WHEN rec % 2 = 0 THEN 2 ELSE 1 END))::BIGINT AS hands, count(*) FILTER (h0 OR h1) AS any_hand, (CASE WHEN rec % 2 = 0 THEN 2 ELSE 1 END)::BIGINT AS expected,
  count(*) FILTER (h0) + count(*) FILTER (h1) AS hand_scores, count(*) FILTER (h0 AND event_id * 11 % 1000 * 1000 < 200000) + count(*) FILTER (h1 AND event_id * 13 % 1000 * 1000 < 200000) AS low_hand_scores,
  [{', '.join(f'count(*) FILTER ({p})' for p, _ in _ANCHORS)}] AS seen, {' + '.join(f'count(*) FILTER ({p} AND {low})' for p, low in _ANCHORS)} AS low_pose_scores FROM frames GROUP BY rec),
metrics AS (SELECT rec, n AS frames, n - bad AS valid, (2 * bad * 1000000 + n) // (2 * n) AS invalid_ppm, expected, hands AS expected_seen, n * expected AS expected_places, (2 * hands * 1000000 + n * expected) // (2 * n * expected) AS coverage_ppm, any_hand, coalesce(gaps, 0) AS gaps, coalesce(filled, 0) AS filled_gaps,
  coalesce(longest_open, 0) AS longest_open, coalesce(longest_open_us, 0) AS longest_open_us, coalesce(jumps, 0) AS jumps, steps, median_step, longest_step, invalid_source, invalid_task, hand_scores, low_hand_scores,
  CASE WHEN hand_scores > 0 THEN (2 * low_hand_scores * 1000000 + hand_scores) // (2 * hand_scores) END AS low_hand_ppm, coalesce(swaps, 0) AS swaps, array_to_string(seen, ',') AS pose_seen,
  array_to_string(list_transform(seen, lambda x: (2 * x * 1000000 + n) // (2 * n)), ',') AS pose_ppm, (2 * list_min(seen) * 1000000 + n) // (2 * n) AS least_pose_ppm, list_sum(seen)::BIGINT AS pose_scores, low_pose_scores, motion_jumps
  FROM base LEFT JOIN g USING (rec) LEFT JOIN j USING (rec) LEFT JOIN st USING (rec) LEFT JOIN medians USING (rec) LEFT JOIN mj USING (rec) LEFT JOIN sw USING (rec))"""
RULES = """rules(metric, higher_is_worse, warning, quarantine, reject) AS (VALUES ('invalid_ppm', TRUE, 20000, 60000, 300000), ('coverage_ppm', FALSE, 800000, 650000, 300000), ('jumps', TRUE, 0, 2, 8), ('longest_open', TRUE, 3, 6, 20)),
findings AS (SELECT rec, metric, value, CASE WHEN higher_is_worse THEN CASE WHEN value > reject THEN 3 WHEN value > quarantine THEN 2 WHEN value > warning THEN 1 END ELSE CASE WHEN value < reject THEN 3 WHEN value < quarantine THEN 2 WHEN value < warning THEN 1 END END AS severity
  FROM (SELECT rec, unnest(['invalid_ppm', 'coverage_ppm', 'jumps', 'longest_open']) AS metric, unnest([invalid_ppm, coverage_ppm, jumps, longest_open]) AS value FROM metrics) JOIN rules USING (metric))"""
THRESHOLDS = [("invalid_ppm", True, 20_000, 60_000, 300_000), ("coverage_ppm", False, 800_000, 650_000, 300_000), ("jumps", True, 0, 2, 8), ("longest_open", True, 3, 6, 20)]


def c11_threshold_findings(spark: SparkSession, sf: str) -> DataFrame:
    return Q.apply_thresholds(d1_quality_metrics(spark, sf), THRESHOLDS)


def d2_dispositions(spark: SparkSession, sf: str) -> DataFrame:
    return Q.with_disposition(d1_quality_metrics(spark, sf), THRESHOLDS).select("rec", "disposition", "findings")


D2 = f"""WITH {METRICS}, {RULES} SELECT m.rec, CASE WHEN m.valid = 0 OR m.any_hand = 0 THEN 'reject' ELSE ['pass', 'warning', 'quarantine', 'reject'][coalesce(max(severity), 0) + 1] END AS disposition, count(severity) AS findings
FROM metrics m LEFT JOIN findings f USING (rec) GROUP BY m.rec, m.valid, m.any_hand"""


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    return Q.with_disposition(d1_quality_metrics(spark, sf), THRESHOLDS)


FLAGSHIP = f"""WITH {METRICS}, {RULES}, d AS (SELECT m.rec, CASE WHEN m.valid = 0 OR m.any_hand = 0 THEN 'reject' ELSE ['pass', 'warning', 'quarantine', 'reject'][coalesce(max(severity), 0) + 1] END AS disposition, count(severity) AS findings
FROM metrics m LEFT JOIN findings f USING (rec) GROUP BY m.rec, m.valid, m.any_hand) SELECT * FROM metrics JOIN d USING (rec)"""


def d3_dataset_quality(spark: SparkSession, sf: str) -> DataFrame:
    return Q.dataset_quality(flagship(spark, sf))


D3 = f"""WITH {FLAGSHIP[5:].replace('SELECT * FROM metrics JOIN d USING (rec)', '')}, a AS (SELECT * FROM metrics JOIN d USING (rec))
SELECT count(*) AS recordings, sum(frames)::BIGINT AS frames, (2 * sum(frames - valid) * 1000000 + sum(frames))::BIGINT // (2 * sum(frames))::BIGINT AS invalid_ppm, min(coverage_ppm) AS least_coverage, max(longest_open) AS longest_open, sum(jumps)::BIGINT AS jumps,
  count(*) FILTER (disposition = 'pass') AS passed, count(*) FILTER (disposition = 'warning') AS warned, count(*) FILTER (disposition = 'quarantine') AS quarantined, count(*) FILTER (disposition = 'reject') AS rejected,
  CASE WHEN count(*) FILTER (disposition IN ('quarantine', 'reject')) > 0 THEN 'blocked' WHEN count(*) FILTER (disposition = 'warning') > 0 THEN 'ready_with_warnings' ELSE 'ready' END AS status FROM a"""


def b14_report_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Reports whose stored disposition was lowered for every third recording must be found."""
    report = flagship(spark, sf)
    told = report.withColumn("disposition", F.when(F.col("rec") % 3 == 0, "pass").otherwise(F.col("disposition")))
    return Q.report_violations(told, Q.apply_thresholds(report, THRESHOLDS))


B14 = f"""WITH {FLAGSHIP[5:].replace('SELECT * FROM metrics JOIN d USING (rec)', '')} SELECT 'disposition_differs' AS rule_id, rec FROM d WHERE rec % 3 = 0 AND disposition <> 'pass'"""


def d24_coverage_diagnostic(spark: SparkSession, sf: str) -> DataFrame:
    return Q.coverage_diagnostic(frames(spark, sf).withColumn("split", F.when(F.col("rec") % 5 == 0, "test").when(F.col("rec") % 5 == 1, "validation").otherwise("train")).withColumn("target", F.col("rec") % 3), F.col("h0"))


D24 = f"""WITH {FRAMES}, s AS (SELECT *, CASE rec % 5 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END AS split, rec % 3 AS target FROM frames),
b AS (SELECT rec, min(i) FILTER (h0) AS lo, max(i) FILTER (h0) AS hi FROM s GROUP BY rec),
c AS (SELECT s.rec, any_value(split) AS split, any_value(target) AS target, (2 * count(*) FILTER (h0) * 1000000 + count(*)) // (2 * count(*)) AS ppm FROM s JOIN b ON b.rec = s.rec AND s.i BETWEEN lo AND hi GROUP BY s.rec)
SELECT split, target, count(*) AS recordings, count(*) FILTER (ppm >= 500000) AS over_50, count(*) FILTER (ppm >= 800000) AS over_80, count(*) FILTER (ppm >= 950000) AS over_95 FROM c GROUP BY ROLLUP (split, target)"""


def e18_timeline_violations(spark: SparkSession, sf: str) -> DataFrame:
    seeded = frames(spark, sf).withColumn("t", F.when(F.col("event_id") % 97 == 0, F.col("t") - 10 * HOUR).otherwise(F.col("t")))
    return Q.timeline_violations(seeded)


E18 = f"""WITH {FRAMES}, s AS (SELECT rec, i, CASE WHEN event_id % 97 = 0 THEN t - {10 * HOUR} ELSE t END AS t FROM frames),
w AS (SELECT *, row_number() OVER w AS k, lag(t) OVER w AS p FROM s WINDOW w AS (PARTITION BY rec ORDER BY i))
SELECT 'time_not_rising' AS rule_id, rec, i FROM w WHERE p IS NOT NULL AND t <= p UNION ALL SELECT 'starts_not_at_zero', rec, i FROM w WHERE k = 1 AND t <> 0 UNION ALL SELECT 'index_gap', rec, i FROM w WHERE i <> k - 1"""


def b6_frame_violations(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf).withColumn("count", F.when(F.col("event_id") % 53 == 0, 2).otherwise(F.col("h0").cast("int") + F.col("h1").cast("int")))
    return Q.frame_violations(f, {"hand_0": F.col("h0"), "hand_1": F.col("h1")}, "count", "invalid")


B6 = f"""WITH {FRAMES}, s AS (SELECT *, CASE WHEN event_id % 53 = 0 THEN 2 ELSE h0::INT + h1::INT END AS c FROM frames)
SELECT 'count_differs' AS rule_id, rec, i FROM s WHERE c <> h0::INT + h1::INT UNION ALL SELECT 'invalid_frame_observed', rec, i FROM s WHERE invalid AND (h0 OR h1)"""


def b7_observations(spark: SparkSession, sf: str) -> DataFrame:
    f = frames(spark, sf)
    slots = {f"hand_{h}": (F.col(f"h{h}"), palm_q(30 * h), palm_q(30 * h, 1)) for h in (0, 1)}
    return Q.project_observations(f.withColumn("t", F.expr("t div 1000000")), slots)


def _motion(k: int, h: str) -> str:
    far = " + ".join(f"abs({palm_q_sql(k, x)} - lag({palm_q_sql(k, x)}) OVER v)" for x in (0, 1))
    return f"CASE WHEN {h} AND lag({h}) OVER v AND t > lag(t) OVER v THEN (({far}) * 1000000 + (t - lag(t) OVER v) // 2) // (t - lag(t) OVER v) END"


B7 = f"""WITH {FRAMES}, s AS (SELECT * REPLACE (t // 1000000 AS t) FROM frames),
m AS (SELECT rec, i, greatest(coalesce({_motion(0, 'h0')}, 0), coalesce({_motion(30, 'h1')}, 0)) AS motion_q FROM s WHERE NOT invalid WINDOW v AS (PARTITION BY rec ORDER BY i))
SELECT s.rec, s.i, s.t, NOT invalid AND (h0 OR h1) AS hand_present, NOT invalid AS quality_ok, coalesce(motion_q, 0) AS motion_q FROM s LEFT JOIN m USING (rec, i)"""


QUERIES = {
    "e1_time_steps": (e1_time_steps, f"WITH {STEPS} SELECT rec, i, t, step FROM steps"),
    "d20_median_steps": (d20_median_steps, f"WITH {STEPS} SELECT rec, median_step FROM medians"),
    "e2_timestamp_discontinuities": (e2_timestamp_discontinuities, f"WITH {STEPS} SELECT rec, i, step, median_step FROM jumps"),
    "e3_motion_discontinuities": (e3_motion_discontinuities, E3),
    "e4_missing_intervals": (e4_missing_intervals, f"WITH {GAPS} SELECT * FROM kinds"),
    "e5_gap_decisions": (e5_gap_decisions, f"WITH {DECIDED} SELECT rec, signal, first_index, last_index, missing, duration, decision, array_to_string(reasons, ',') AS reasons FROM decided"),
    "c9_gap_barriers": (c9_gap_barriers, f"WITH {DECIDED} SELECT rec, count(*) AS gaps, count(*) FILTER (jumped) AS jumped, count(*) FILTER (has_invalid) AS with_invalid, count(*) FILTER (swapped) AS swapped, count(*) FILTER (ambiguous) AS ambiguous, count(*) FILTER (unsure) AS unsure FROM decided GROUP BY rec"),
    "e6_suspected_swaps": (e6_suspected_swaps, E6),
    "e7_episodes": (e7_episodes, f"WITH {EPISODES} SELECT * FROM episodes"),
    "f1_best_episodes": (f1_best_episodes, f"WITH {BEST} SELECT * FROM best"),
    "f2_sliced_frames": (f2_sliced_frames, F2),
    "e8_e9_differences": (e8_differences, E8),
    "e10_smoothed": (e10_smoothed, E10),
    "e11_monotone_ms": (e11_monotone_ms, E11),
    "c7_bracket_join": (c7_bracket_join, C7),
    "c8_gap_at": (c8_gap_at, C8),
    "h13_time_grid": (h13_time_grid, H13),
    "f5_uniform_selection": (f5_uniform_selection, F5),
    "h12_padded_sequences": (h12_padded, H12),
    "b5_observation_counts": (b5_observation_counts, B5),
    "d1_quality_metrics": (d1_quality_metrics, f"WITH {METRICS} SELECT * FROM metrics"),
    "c11_threshold_findings": (c11_threshold_findings, f"WITH {METRICS}, {RULES} SELECT rec, metric, value, ['warning', 'quarantine', 'reject'][severity] AS severity FROM findings WHERE severity IS NOT NULL"),
    "d2_dispositions": (d2_dispositions, D2),
    "flagship_quality": (flagship, FLAGSHIP),
    "d3_dataset_quality": (d3_dataset_quality, D3),
    "b14_report_violations": (b14_report_violations, B14),
    "d24_coverage_diagnostic": (d24_coverage_diagnostic, D24),
    "e18_timeline_violations": (e18_timeline_violations, E18),
    "b6_frame_violations": (b6_frame_violations, B6),
    "b7_observations": (b7_observations, B7),
}
