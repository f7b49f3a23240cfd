"""Queries of metrics, matching and model jobs. Probabilities are made of integers, so that both engines have the same ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import folds as G
from ..operators import matching as T
from ..operators import metrics as M
from ..operators import models as J
from ..operators import resampling as R
from ..sources.staging import written
from .bindings import FRAMES, HOUR, frames, table

CLASSES = list(range(10))


def scored(spark: SparkSession, sf: str) -> DataFrame:
    """vec_id, label, p (10 class probabilities), confidence, predicted."""
    e = table(spark, sf, "embeddings").select("vec_id", "label")
    w = [1 + (F.col("vec_id") * (31 + 7 * k)) % 97 + F.when(F.col("label") == k, 60).otherwise(0) for k in CLASSES]
    e = e.withColumn("w", F.array(*(x.cast("double") for x in w)))
    e = e.withColumn("s", F.aggregate("w", F.lit(0.0), lambda a, x: a + x))
    return M.top(e.select("vec_id", "label", F.transform("w", lambda x: x / F.col("s")).alias("p")))


SCORED = """w AS (SELECT vec_id, label, list_transform(range(10), lambda k: (1 + (vec_id * (31 + 7 * k)) % 97 + CASE WHEN k = label THEN 60 ELSE 0 END)::DOUBLE) AS w FROM embeddings),
ps AS (SELECT vec_id, label, list_transform(w, lambda x: x / list_sum(w)) AS p FROM w),
scored AS (SELECT *, list_max(p) AS confidence, CAST(list_position(p, list_max(p)) - 1 AS INTEGER) AS predicted FROM ps)"""
CELLS = f"""{SCORED}, l(l) AS (SELECT unnest(range(10))::INTEGER), cells AS (SELECT a.l AS actual, b.l AS predicted, count(s.vec_id) AS n FROM l a CROSS JOIN l b LEFT JOIN scored s ON s.label = a.l AND s.predicted = b.l GROUP BY 1, 2),
classes AS (SELECT l AS label, sum(CASE WHEN actual = l THEN n ELSE 0 END)::BIGINT AS support, sum(CASE WHEN actual = l AND predicted = l THEN n ELSE 0 END)::BIGINT AS hits, sum(CASE WHEN predicted = l THEN n ELSE 0 END)::BIGINT AS said FROM l, cells GROUP BY l),
rates AS (SELECT label, support, hits, CASE WHEN said > 0 THEN hits / said ELSE 0 END AS precision, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS recall FROM classes),
full_ AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM rates)"""


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in columns})


def d6_confusion(spark, sf):
    return M.confusion(scored(spark, sf), "label", "predicted", CLASSES)


def d7_class_metrics(spark, sf):
    return _rounded(M.class_metrics(d6_confusion(spark, sf)), "precision", "recall", "f1")


def d7_overall_metrics(spark, sf):
    return _rounded(M.overall_metrics(M.class_metrics(d6_confusion(spark, sf))), "accuracy", "macro_f1", "balanced_accuracy")


def d8_probability_scores(spark, sf):
    return _rounded(M.probability_scores(scored(spark, sf)), "log_loss", "brier")


D8 = f"WITH {SCORED} SELECT round(avg(-ln(p[label + 1])), 6) AS log_loss, round(avg(list_sum(list_transform(range(10), lambda k: power(p[k + 1] - CASE WHEN k = label THEN 1 ELSE 0 END, 2)))), 6) AS brier FROM scored"


def d9_reliability(spark, sf):
    return _rounded(M.reliability(scored(spark, sf).withColumn("confidence", F.col("confidence") * 3)), "confidence", "accuracy", "gap")


D9 = f"""WITH {SCORED}, b AS (SELECT least(floor(confidence * 3 * 10), 9)::INTEGER AS bin, count(*) AS n, avg(confidence * 3) AS confidence, avg((predicted = label)::INT) AS accuracy FROM scored GROUP BY 1)
SELECT k::INTEGER AS bin, coalesce(n, 0) AS n, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy, round(abs(confidence - accuracy), 6) AS gap FROM range(10) r(k) LEFT JOIN b ON bin = k"""


def _curve(spark, sf):
    """The last class stands for what isn't a target."""
    return M.risk_coverage(scored(spark, sf).withColumn("confidence", F.col("confidence") * 3), target=F.col("label") < 9, said_target=F.col("predicted") < 9)


def d10_risk_coverage(spark, sf):
    return _rounded(_curve(spark, sf), "coverage", "risk", "target_coverage", "correct_target_coverage", "target_accuracy", "abstention_rate", "non_target_rate", "false_acceptance")


CURVE = f"""{SCORED}, sums AS (SELECT count(*) AS n, count(*) FILTER (label < 9) AS t, count(*) FILTER (label >= 9) AS f FROM scored),
cut AS (SELECT k::INTEGER AS percent, count(s.vec_id) AS accepted, count(s.vec_id) FILTER (predicted <> label) AS errors, count(s.vec_id) FILTER (label < 9) AS taken_t, count(s.vec_id) FILTER (label < 9 AND predicted = label) AS ct,
  count(s.vec_id) FILTER (label >= 9) AS af, count(s.vec_id) FILTER (label >= 9 AND predicted < 9) AS sf FROM range(101) r(k) LEFT JOIN scored s ON confidence * 3 >= k / 100 GROUP BY 1),
curve AS (SELECT percent, accepted, errors, accepted / n AS coverage, CASE WHEN accepted > 0 THEN errors / accepted END AS risk, CASE WHEN t > 0 THEN taken_t / t END AS target_coverage, CASE WHEN t > 0 THEN ct / t END AS correct_target_coverage,
  CASE WHEN taken_t > 0 THEN ct / taken_t END AS target_accuracy, taken_t - ct AS target_errors, CASE WHEN f > 0 THEN 1 - af / f END AS abstention_rate, CASE WHEN f > 0 THEN 1 - sf / f END AS non_target_rate, CASE WHEN f > 0 THEN sf / f END AS false_acceptance FROM cut, sums)"""
D10 = f"""WITH {CURVE} SELECT percent, accepted, errors, target_errors, round(coverage, 6) AS coverage, round(risk, 6) AS risk, round(target_coverage, 6) AS target_coverage, round(correct_target_coverage, 6) AS correct_target_coverage,
  round(target_accuracy, 6) AS target_accuracy, round(abstention_rate, 6) AS abstention_rate, round(non_target_rate, 6) AS non_target_rate, round(false_acceptance, 6) AS false_acceptance FROM curve"""


def f6_threshold(spark, sf):
    return _rounded(M.choose_threshold(_curve(spark, sf)), "coverage", "correct_target_coverage")


F6 = f"""WITH {CURVE}, o AS (SELECT * FROM curve WHERE errors = 0 AND correct_target_coverage > 0 ORDER BY correct_target_coverage DESC, coverage DESC, percent LIMIT 1)
SELECT CASE WHEN o.percent IS NULL THEN 'no_viable_operating_point' ELSE 'selected' END AS status, o.percent, round(o.coverage, 6) AS coverage, round(o.correct_target_coverage, 6) AS correct_target_coverage FROM (SELECT 1) LEFT JOIN o ON TRUE"""


def f7_temperature(spark, sf):
    return _rounded(M.fit_temperature(scored(spark, sf)), "log_loss")


F7 = f"""WITH {SCORED}, g AS (SELECT unnest(range(50, 10001))::INTEGER AS g), z AS (SELECT label, list_transform(p, lambda x: ln(x)) AS z FROM scored),
l AS (SELECT g, avg(least(-ln(1e-12::DOUBLE), ln(list_sum(list_transform(z, lambda x: exp((x - list_max(z)) / (g / 1000.0::DOUBLE))))) - (z[label + 1] - list_max(z)) / (g / 1000.0::DOUBLE))) AS log_loss FROM z, g GROUP BY g)
SELECT g AS temperature_milli, round(log_loss, 6) AS log_loss FROM l ORDER BY log_loss.log_loss IS NULL, l.log_loss, abs(g - 1000), g LIMIT 1""".replace("log_loss.log_loss IS NULL, ", "")


def h11_softmax(spark, sf):
    return scored(spark, sf).select("vec_id", F.transform(S.temperature_softmax(F.col("p"), 0.5), lambda x: F.round(x, 6)).alias("q")).select("vec_id", F.posexplode("q").alias("k", "q"))


H11 = f"""WITH {SCORED}, s AS (SELECT vec_id, list_transform(p, lambda x: x * x) AS q FROM scored) SELECT vec_id, unnest(range(10))::INTEGER AS k, unnest(list_transform(q, lambda x: round(x / list_sum(q), 6))) AS q FROM s"""


def b11_decisions(spark, sf):
    return J.decide(scored(spark, sf), 0.2, 9).select("vec_id", "decision", "reason", "predicted")


B11 = f"WITH {SCORED} SELECT vec_id, CASE WHEN confidence < 0.2::DOUBLE THEN 'abstain' WHEN predicted = 9 THEN 'other' ELSE 'target' END AS decision, CASE WHEN confidence < 0.2::DOUBLE THEN 'below_threshold' ELSE 'accepted' END AS reason, CASE WHEN confidence >= 0.2::DOUBLE THEN predicted END AS predicted FROM scored"


def b13_probability_violations(spark, sf):
    seeded = scored(spark, sf).withColumn("p", F.when(F.col("vec_id") % 17 == 0, F.slice("p", 1, 9)).when(F.col("vec_id") % 19 == 0, F.transform("p", lambda x: x - 0.05)).otherwise(F.col("p")))
    return J.probability_violations(seeded, "vec_id", length=10)


B13 = f"""WITH {SCORED}, s AS (SELECT vec_id, CASE WHEN vec_id % 17 = 0 THEN p[1:9] WHEN vec_id % 19 = 0 THEN list_transform(p, lambda x: x - 0.05::DOUBLE) ELSE p END AS p FROM scored)
SELECT 'bad_value' AS rule_id, vec_id FROM s WHERE list_min(p) < 0 UNION ALL SELECT 'bad_sum', vec_id FROM s WHERE abs(list_sum(p) - 1) > 1e-6 UNION ALL SELECT 'bad_length', vec_id FROM s WHERE len(p) <> 10"""


def b8_feature_view(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: S.quantize(x.cast("double"))).alias("v"))
    return J.feature_view(e, "v", (3, 1, 40)).select("vec_id", F.posexplode("v").alias("k", "v"))


B8 = """WITH e AS (SELECT vec_id, list_transform([embedding[4], embedding[2], embedding[41]], lambda x: floor(x::DOUBLE * 1000000 + 0.5)::BIGINT) AS v FROM embeddings) SELECT vec_id, unnest(range(3))::INTEGER AS k, unnest(v) AS v FROM e"""


def b9_vectorized(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), lambda k: F.transform(F.slice("embedding", 8 * k + 1, F.lit(8)), lambda x: S.quantize(x.cast("double")))).alias("f"))
    return J.dequantize(e, "f").select("vec_id", F.size("vector").alias("width"), F.round(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


B9 = "SELECT vec_id, len(embedding)::INTEGER AS width, round(list_sum(list_transform(embedding, lambda x: floor(x::DOUBLE * 1000000 + 0.5) / 1000000)), 6) AS total FROM embeddings"


def _quantized(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: S.quantize(x.cast("double"))).alias("v"))


def d4_feature_statistics(spark, sf):
    return M.fit_statistics(_quantized(spark, sf).where("vec_id % 5 > 1"), "v")


STATS = """q AS (SELECT vec_id, unnest(range(64))::INTEGER AS feature, unnest(list_transform(embedding, lambda x: floor(x::DOUBLE * 1000000 + 0.5)::BIGINT)) AS v FROM embeddings),
s AS (SELECT feature, count(*) AS n, sum(v)::HUGEINT AS s, sum(v::HUGEINT * v)::HUGEINT AS q FROM q WHERE vec_id % 5 > 1 GROUP BY feature),
r AS (SELECT *, floor(sqrt((n * q - s * s)::DOUBLE) / n + 0.5)::HUGEINT AS r FROM s),
st AS (SELECT feature, n, (CASE WHEN s < 0 THEN -((2 * -s + n) // (2 * n)) ELSE (2 * s + n) // (2 * n) END)::BIGINT AS mean,
  greatest(1, CASE WHEN r > 0 AND (2 * r - 1) * (2 * r - 1) * n * n > 4 * (n * q - s * s) THEN r - 1 WHEN (2 * r + 1) * (2 * r + 1) * n * n <= 4 * (n * q - s * s) THEN r + 1 ELSE r END)::BIGINT AS sd FROM r)"""


def d5_standardized(spark, sf):
    q = _quantized(spark, sf)
    z = M.apply_statistics(q, M.fit_statistics(q.where("vec_id % 5 > 1"), "v"), "v")
    return z.select("vec_id", F.posexplode("v").alias("feature", "z"))


D5 = f"""WITH {STATS} SELECT vec_id, feature, CASE WHEN v < mean THEN -((2 * (mean - v) * 1000000 + sd) // (2 * sd)) ELSE (2 * (v - mean) * 1000000 + sd) // (2 * sd) END AS z FROM q JOIN st USING (feature)"""


def d12_nearest_rank(spark, sf):
    return M.nearest_rank(table(spark, sf, "lineitem"), "l_extendedprice", (50, 90, 95), "l_returnflag")


D12 = "SELECT l_returnflag, " + ", ".join(f"quantile_disc(l_extendedprice, {p / 100}) AS p{p}" for p in (50, 90, 95)) + " FROM lineitem GROUP BY 1"


def _truths(spark, sf):
    f = frames(spark, sf).where("kind = 'signup'")
    return f.select(F.col("rec").alias("session"), F.col("event_id").alias("truth_id"), F.col("t").alias("start_us"), (F.col("t") + 8 * HOUR).alias("end_us"), (F.col("event_id") % 3).alias("label"))


def _decisions(spark, sf):
    f = frames(spark, sf).where("kind = 'purchase'")
    kind = F.when(F.col("event_id") % 5 == 0, "abstain").when(F.col("event_id") % 5 == 1, "other").otherwise("target")
    return f.select(F.col("rec").alias("session"), F.col("event_id").alias("decision_id"), (F.col("t") - 2 * HOUR).alias("start_us"), (F.col("t") + 6 * HOUR).alias("end_us"), kind.alias("kind"), (F.col("event_id") % 3).alias("label"))


MATCHED = f"""{FRAMES},
truths AS (SELECT rec AS session, event_id AS truth_id, t AS start_us, t + {8 * HOUR} AS end_us, event_id % 3 AS label FROM frames WHERE kind = 'signup'),
decisions AS (SELECT rec AS session, event_id AS decision_id, t - {2 * HOUR} AS start_us, t + {6 * HOUR} AS end_us, CASE event_id % 5 WHEN 0 THEN 'abstain' WHEN 1 THEN 'other' ELSE 'target' END AS kind, event_id % 3 AS label FROM frames WHERE kind = 'purchase'),
pairs AS (SELECT t.session, truth_id, t.start_us AS ts, decision_id, d.start_us AS ds, greatest(least(t.end_us, d.end_us) - greatest(t.start_us, d.start_us), 0) AS both_ FROM truths t JOIN decisions d ON t.session = d.session AND t.start_us < d.end_us AND d.start_us < t.end_us WHERE d.kind <> 'abstain'),
edges AS (SELECT *, both_ * 1000000 // ({16 * HOUR} - both_) AS iou FROM pairs WHERE both_ * 1000000 // ({16 * HOUR} - both_) >= 200000),
turns AS (SELECT session, truth_id, row_number() OVER (PARTITION BY session ORDER BY ts, truth_id) AS k FROM (SELECT DISTINCT session, truth_id, ts FROM edges)),
r AS (SELECT session, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS truth_id, NULL::BIGINT AS decision_id, NULL::BIGINT AS iou FROM (SELECT DISTINCT session FROM edges)
  UNION ALL SELECT x.session, x.k, CASE WHEN x.d IS NULL THEN x.used ELSE list_append(x.used, x.d.i) END, x.truth_id, x.d.i, x.d.o FROM (
    SELECT r.session, r.k + 1 AS k, r.used, t.truth_id, (SELECT struct_pack(i := e.decision_id, o := e.iou) FROM edges e WHERE e.session = r.session AND e.truth_id = t.truth_id AND NOT list_contains(r.used, e.decision_id) ORDER BY e.iou DESC, e.ds, e.decision_id LIMIT 1) AS d
    FROM r JOIN turns t ON t.session = r.session AND t.k = r.k + 1) x),
matches AS (SELECT session, truth_id, decision_id, iou FROM r WHERE decision_id IS NOT NULL)"""


def c6_interval_matches(spark, sf):
    return T.match_intervals(_truths(spark, sf), _decisions(spark, sf).where("kind <> 'abstain'"))


COUNTS = f"""{MATCHED},
m AS (SELECT x.session, count(*) AS matches, count(*) FILTER (t.label = d.label AND d.kind = 'target') AS correct FROM matches x JOIN truths t USING (session, truth_id) JOIN decisions d USING (session, decision_id) GROUP BY 1),
f AS (SELECT d.session, count(*) AS duplicates FROM decisions d WHERE kind <> 'abstain' AND NOT EXISTS (SELECT 1 FROM matches x WHERE x.session = d.session AND x.decision_id = d.decision_id) AND EXISTS (SELECT 1 FROM truths t WHERE t.session = d.session AND d.start_us < t.end_us AND t.start_us < d.end_us) GROUP BY 1),
t1 AS (SELECT session, count(*) AS truths FROM truths GROUP BY 1), d1 AS (SELECT session, count(*) FILTER (kind <> 'abstain') AS accepted, count(*) FILTER (kind = 'other') AS other, count(*) FILTER (kind = 'abstain') AS abstained FROM decisions GROUP BY 1),
counts AS (SELECT session, coalesce(truths, 0) AS truths, coalesce(accepted, 0) AS accepted, coalesce(other, 0) AS other, coalesce(abstained, 0) AS abstained, coalesce(matches, 0) AS matches, coalesce(correct, 0) AS correct, coalesce(duplicates, 0) AS duplicates,
  coalesce(truths, 0) - coalesce(matches, 0) AS misses, coalesce(accepted, 0) - coalesce(matches, 0) - coalesce(duplicates, 0) AS false_activations FROM t1 FULL JOIN d1 USING (session) FULL JOIN m USING (session) FULL JOIN f USING (session))"""


def d11_replay_counts(spark, sf):
    t, d = _truths(spark, sf), _decisions(spark, sf)
    return T.replay_counts(t, d, T.match_intervals(t, d.where("kind <> 'abstain'")))


def d11_replay_metrics(spark, sf):
    return T.replay_metrics(d11_replay_counts(spark, sf), 1000 * HOUR)


D11B = f"""WITH RECURSIVE {COUNTS}, s AS (SELECT sum(truths)::BIGINT AS truths, sum(accepted)::BIGINT AS accepted, sum(matches)::BIGINT AS matches, sum(correct)::BIGINT AS correct, sum(misses)::BIGINT AS misses, sum(duplicates)::BIGINT AS duplicates, sum(false_activations)::BIGINT AS false_activations FROM counts)
SELECT *, round(matches / accepted, 6) AS precision, round(matches / truths, 6) AS recall, round(2 * matches / (accepted + truths), 6) AS f1, round(false_activations * 3.6e9::DOUBLE / {1000 * HOUR}, 6) AS false_per_hour FROM s"""


def c16_ordered_match(spark, sf):
    found = T.ordered_match(_truths(spark, sf), _decisions(spark, sf).where("kind <> 'abstain'"))
    return found.withColumns({c: F.round(c, 2) for c in ("onset_error", "offset_error")})


C16 = f"""WITH RECURSIVE {MATCHED}, a AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY start_us, end_us) AS k FROM truths), b AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY start_us, end_us) AS k FROM decisions WHERE kind <> 'abstain')
SELECT coalesce(a.session, b.session) AS session, count(a.k) AS truths, count(b.k) AS events, bool_and(coalesce(a.start_us < b.end_us AND b.start_us < a.end_us, FALSE)) AS conforms, round(avg(abs(b.start_us - a.start_us)), 2) AS onset_error, round(avg(abs(b.end_us - a.end_us)), 2) AS offset_error FROM a FULL JOIN b ON a.session = b.session AND a.k = b.k GROUP BY 1"""


def d13_bootstrap(spark, sf):
    return _rounded(M.group_bootstrap(d11_replay_counts(spark, sf), "session", "matches", "truths", 200, 7), "low", "high")


D13 = f"""WITH RECURSIVE {COUNTS}, g AS (SELECT session, matches, truths, row_number() OVER (ORDER BY session) - 1 AS k, count(*) OVER () AS n FROM counts),
dr AS (SELECT id // n AS r, ('0x' || substr(md5('7:' || id // n || ':' || id % n), 1, 8))::BIGINT % n AS p FROM (SELECT unnest(range(200 * n)) AS id, n FROM (SELECT count(*) AS n FROM counts))),
v AS (SELECT r, sum(matches) / sum(truths) AS v FROM dr JOIN g ON k = p GROUP BY r) SELECT (SELECT count(*) FROM counts) AS groups, round(quantile_disc(v, 0.025), 6) AS low, round(quantile_disc(v, 0.975), 6) AS high FROM v"""


def d13_bootstrap_ratios(spark, sf):
    """Three ratios of the sessions' counts from one draw."""
    ratios = {"recall": ("matches", "truths"), "correct": ("correct", "matches"), "duplicates": ("duplicates", "accepted")}
    return _rounded(R.bootstrap_ratios(d11_replay_counts(spark, sf), "session", ratios, 200, 7), "low", "high")


def d14_strata(spark, sf):
    d = scored(spark, sf).withColumn("signer", F.col("vec_id") % 40).withColumn("quality", F.when(F.col("vec_id") % 7 == 0, "warning").otherwise("pass"))
    return M.strata(d, "label", "predicted", "label", "quality", "signer")


D14 = f"""WITH {SCORED}, u AS (SELECT 'label' AS dimension, label::VARCHAR AS value, predicted <> label AS e FROM scored UNION ALL SELECT 'quality', CASE WHEN vec_id % 7 = 0 THEN 'warning' ELSE 'pass' END, predicted <> label FROM scored UNION ALL SELECT 'signer', (vec_id % 40)::VARCHAR, predicted <> label FROM scored)
SELECT dimension, value, count(*) AS n, count(*) FILTER (e) AS errors FROM u GROUP BY 1, 2"""


def d15_exclusions(spark, sf):
    f = frames(spark, sf).withColumn("split", F.when(F.col("rec") % 5 == 0, "test").otherwise("train")).withColumn("reason", F.when(F.col("invalid"), "invalid_frame").when(~F.col("h0"), "no_hand").otherwise("used"))
    return f.rollup("split", "reason").agg(F.count("*").alias("n"))


D15 = f"WITH {FRAMES} SELECT split, reason, count(*) AS n FROM (SELECT CASE WHEN rec % 5 = 0 THEN 'test' ELSE 'train' END AS split, CASE WHEN invalid THEN 'invalid_frame' WHEN NOT h0 THEN 'no_hand' ELSE 'used' END AS reason FROM frames) GROUP BY ROLLUP (split, reason)"


def _conditions(spark, sf):
    s = scored(spark, sf).withColumn("fold", (F.col("vec_id") % 3).cast("int"))
    worse = F.when(F.col("vec_id") % 4 == 0, F.pmod(F.col("label") + 1, F.lit(10)).cast("int")).otherwise(F.col("predicted"))
    a = s.select(F.lit("full").alias("condition"), "fold", F.col("label").alias("actual"), "predicted")
    return a.unionByName(s.select(F.lit("reduced").alias("condition"), "fold", F.col("label").alias("actual"), worse.alias("predicted")))


def d17_fold_summary(spark, sf):
    return _rounded(M.fold_summary(_conditions(spark, sf), CLASSES), "accuracy", "macro_f1", "balanced_accuracy")


FOLDS = f"""{SCORED}, c0 AS (SELECT 'full' AS condition, (vec_id % 3)::INTEGER AS fold, label AS actual, predicted FROM scored UNION ALL SELECT 'reduced', (vec_id % 3)::INTEGER, label, CASE WHEN vec_id % 4 = 0 THEN (label + 1) % 10 ELSE predicted END FROM scored),
c AS (SELECT * FROM c0 UNION ALL SELECT condition, NULL, actual, predicted FROM c0), k AS (SELECT DISTINCT condition, fold, l::INTEGER AS l FROM c, range(10) r(l)),
x AS (SELECT k.condition, k.fold, l, count(*) FILTER (actual = l) AS support, count(*) FILTER (actual = l AND predicted = l) AS hits, count(*) FILTER (predicted = l) AS said FROM k JOIN c ON k.condition = c.condition AND k.fold IS NOT DISTINCT FROM c.fold GROUP BY ALL),
y AS (SELECT *, CASE WHEN said > 0 THEN hits / said ELSE 0 END AS pr, CASE WHEN support > 0 THEN hits / support ELSE 0 END AS re FROM x),
summary AS (SELECT condition, fold, sum(support)::BIGINT AS n, sum(hits) / sum(support) AS accuracy, avg(CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END) AS macro_f1, avg(re) FILTER (support > 0) AS balanced_accuracy FROM y GROUP BY ALL)"""


def d18_condition_compare(spark, sf):
    return _rounded(M.compare_conditions(M.fold_summary(_conditions(spark, sf), CLASSES), "reduced", "full", 0.02), "gain")


D18 = f"""WITH {FOLDS}, d AS (SELECT b.fold, b.macro_f1 - a.macro_f1 AS d FROM summary a JOIN summary b ON a.condition = 'reduced' AND b.condition = 'full' AND a.fold IS NOT DISTINCT FROM b.fold),
v AS (SELECT bool_and(d > 0) FILTER (fold IS NOT NULL) AS better, bool_and(d < 0) FILTER (fold IS NOT NULL) AS worse, max(d) FILTER (fold IS NULL) AS gain FROM d) SELECT CASE WHEN better AND gain >= 0.02 THEN 'supported' WHEN worse OR better THEN 'unsupported' ELSE 'inconclusive' END AS verdict, round(gain, 6) AS gain FROM v"""


def d22_throughput(spark, sf):
    e = table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    found = M.throughput(e, "at", "6 hours", F.col("event_type") != "error", F.col("event_type") == "error", F.floor("value").cast("bigint"), 50)
    return found.withColumn("start", F.unix_micros("start"))


D22 = "SELECT epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) AS start, count(*) FILTER (event_type <> 'error') AS processed, count(*) FILTER (event_type = 'error') AS dropped, CAST(floor(count(*) FILTER (event_type = 'error') * 1000000 / count(*) + 0.5) AS BIGINT) AS drop_ppm, count(*) FILTER (floor(value) > 50) AS long_tasks, coalesce(sum(floor(value)::BIGINT) FILTER (floor(value) > 50), 0)::BIGINT AS long_ms, coalesce(max(floor(value)::BIGINT) FILTER (floor(value) > 50), 0) AS longest_ms FROM events GROUP BY 1"


def d23_centroids(spark, sf):
    c = M.fit_centroids(table(spark, sf, "embeddings").withColumn("e", F.transform("embedding", lambda x: x.cast("double"))), "e", "label")
    return c.select("label", F.posexplode("centroid").alias("k", "x")).withColumn("x", F.round("x", 6))


D23 = "SELECT label, k::INTEGER AS k, round(avg(x::DOUBLE), 6) AS x FROM (SELECT label, unnest(range(64)) AS k, unnest(embedding) AS x FROM embeddings) GROUP BY 1, 2"


def d23_centroid_scores(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("e", F.transform("embedding", lambda x: x.cast("double")))
    return M.score_centroids(e, M.fit_centroids(e, "e", "label"), "e", "label").select("vec_id", "label", "predicted", F.round(F.array_max("scores"), 6).alias("best"))


D23B = """WITH c AS (SELECT label, list(m ORDER BY k) AS c FROM (SELECT label, k, avg(x::DOUBLE) AS m FROM (SELECT label, unnest(range(64)) AS k, unnest(embedding) AS x FROM embeddings) GROUP BY 1, 2) GROUP BY 1),
s AS (SELECT e.vec_id, e.label, c.label AS cl, 2 * list_sum(list_transform(range(1, 65), lambda i: e.embedding[i]::DOUBLE * c.c[i])) - list_sum(list_transform(c.c, lambda x: x * x)) AS s FROM embeddings e, c)
SELECT vec_id, label, arg_max(cl, s) AS predicted, round(max(s), 6) AS best FROM s GROUP BY 1, 2"""


def c15_compared_runs(spark, sf):
    a = scored(spark, sf)
    b = a.select("vec_id", F.transform("p", lambda x, k: x + F.when((F.col("vec_id") + k) % 50 == 0, 0.001).otherwise(0.0)).alias("p"))
    return _rounded(M.compare_runs(a, b, "vec_id", "p", 1e-5, 1e-5, 0.2), "max_difference")


C15 = f"""WITH {SCORED}, b AS (SELECT *, list_transform(range(10), lambda k: p[k + 1] + CASE WHEN (vec_id + k) % 50 = 0 THEN 0.001::DOUBLE ELSE 0 END) AS q FROM scored)
SELECT vec_id, round(list_max(list_transform(range(1, 11), lambda k: abs(p[k] - q[k]))), 6) AS max_difference, len(list_filter(range(1, 11), lambda k: abs(p[k] - q[k]) > 1e-5 + 1e-5 * abs(q[k]))) = 0 AS within, list_position(p, list_max(p)) = list_position(q, list_max(q)) AS same_class,
  CASE WHEN list_max(p) >= 0.2::DOUBLE THEN list_position(p, list_max(p)) END IS NOT DISTINCT FROM CASE WHEN list_max(q) >= 0.2::DOUBLE THEN list_position(q, list_max(q)) END AS same_decision FROM b"""


def m4_group_folds(spark, sf):
    return G.group_folds(table(spark, sf, "orders"), "o_custkey", "o_orderpriority", 3)


def m4_fold_checks(spark, sf):
    """Each customer is in one fold, each fold has all priorities on both sides, and a priority's share of a fold is near a third."""
    orders = table(spark, sf, "orders")
    folds = written(m4_group_folds(spark, sf), "folds")
    found = G.fold_checks(orders, folds, "o_custkey", "o_orderpriority", 3)
    whole = folds.groupBy("o_custkey").agg(F.count("*").alias("n")).agg(F.max("n").alias("most"), F.count("*").alias("customers"))
    share = F.col("evaluated") / (F.col("evaluated") + F.col("fitted"))
    return found.crossJoin(F.broadcast(whole)).select("fold", "o_orderpriority", (F.col("most") == 1).alias("whole"), "customers", ((F.col("evaluated") > 0) & (F.col("fitted") > 0)).alias("both_sides"), (F.abs(share - 1 / 3) < 0.02).alias("even"))


M4 = "SELECT CAST(f AS INTEGER) AS fold, o_orderpriority, TRUE AS whole, customers, TRUE AS both_sides, TRUE AS even FROM (SELECT DISTINCT o_orderpriority FROM orders), range(3) x(f), (SELECT count(DISTINCT o_custkey) AS customers FROM orders)"


def m4_fold_digest(spark, sf):
    """One digest for two runs on tables that are dealt otherwise."""
    orders = table(spark, sf, "orders")
    twice = [G.fold_digest(G.group_folds(o, "o_custkey", "o_orderpriority", 3), "o_custkey") for o in (orders, orders.repartition(5, "o_orderkey"))]
    return twice[0].unionAll(twice[1]).groupBy("digest").agg(F.count("*").alias("runs"), F.max("rows").alias("customers")).select("runs", "customers")


def m5_baselines(spark, sf):
    train, test = table(spark, sf, "embeddings").where("vec_id % 5 > 1"), table(spark, sf, "embeddings").where("vec_id % 5 = 0").select("vec_id", "label")
    drawn = J.stratified_random(test, J.class_shares(train, "label"), "vec_id", "label", 11)
    return drawn.crossJoin(F.broadcast(J.majority(train, "label").withColumnRenamed("label", "majority")))


M5 = """WITH t AS (SELECT label, count(*) AS n FROM embeddings WHERE vec_id % 5 > 1 GROUP BY 1), s AS (SELECT *, sum(n) OVER (ORDER BY label)::BIGINT AS upto, sum(n) OVER ()::BIGINT AS total FROM t),
d AS (SELECT vec_id, label, ('0x' || substr(md5('11:' || vec_id), 1, 8))::BIGINT % (SELECT any_value(total) FROM s) AS d FROM embeddings WHERE vec_id % 5 = 0)
SELECT vec_id, label, (SELECT min(s.label) FROM s WHERE upto > d.d) AS predicted, (SELECT label FROM t ORDER BY n DESC, label LIMIT 1) AS majority FROM d"""


def m5_logistic(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("e", F.transform("embedding", lambda x: x.cast("double")))
    model, _ = J.fit_logistic_grid(e.where("vec_id % 5 > 1"), e.where("vec_id % 5 = 1"), "e", "label", CLASSES, iterations=30)
    return M.top(J.predict_logistic(model, e.where("vec_id % 5 = 0"), "e")).groupBy("label", "predicted").agg(F.count("*").alias("n"))


#: Candidates c and how often each is wrong, by integer arithmetic on vec_id; two are equal.
CANDIDATES = {0.1: 3, 1.0: 7, 10.0: 7, 100.0: 5}


def f8_model_choice(spark, sf):
    rows = table(spark, sf, "embeddings").where("vec_id % 5 = 1").select("vec_id", "label")
    said = {c: rows.withColumn("predicted", F.when(F.col("vec_id") % n == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))) for c, n in CANDIDATES.items()}
    return _rounded(J.choose_model(J.validation_scores(said, "label", CLASSES)), "macro_f1")


F8 = f"""WITH g(c, n) AS (VALUES {', '.join(f'({c}::DOUBLE, {n})' for c, n in CANDIDATES.items())}),
r AS (SELECT c, label, CASE WHEN vec_id % n = 0 THEN (label + 1) % 10 ELSE label END AS predicted FROM g, embeddings WHERE vec_id % 5 = 1),
k AS (SELECT c, l, count(*) FILTER (label = l AND predicted = l) AS hits, count(*) FILTER (label = l) AS support, count(*) FILTER (predicted = l) AS said FROM r, (SELECT unnest(range(10)) AS l) GROUP BY c, l),
s AS (SELECT c, avg(CASE WHEN hits > 0 THEN 2 * (hits / said) * (hits / support) / (hits / said + hits / support) ELSE 0 END) AS macro_f1 FROM k GROUP BY c)
SELECT c, round(macro_f1, 6) AS macro_f1 FROM s ORDER BY s.macro_f1 DESC, c LIMIT 1"""


def m7_calibration(spark, sf):
    return _rounded(J.calibrate(scored(spark, sf)), "log_loss_before", "brier_before", "log_loss_after", "brier_after", "coverage")


def m8_ablation(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("e", F.transform("embedding", lambda x: x.cast("double"))).withColumn("fold", (F.col("vec_id") % 2).cast("int"))
    out = None
    for name, view in (("full", tuple(range(64))), ("half", tuple(range(0, 64, 2)))):
        for fold in (0, 1):
            data = J.feature_view(e, "e", view)
            p = M.top(J.predict_logistic(J.fit_logistic(data.where(F.col("fold") != fold), "e", "label", 10.0, 10), data.where(F.col("fold") == fold), "e"))
            part = p.select(F.lit(name).alias("condition"), "fold", F.col("label").alias("actual"), F.col("predicted").cast("int").alias("predicted"))
            out = part if out is None else out.unionByName(part)
    return _rounded(M.fold_summary(out, CLASSES), "accuracy", "macro_f1", "balanced_accuracy")


def j3_scored(spark, sf):
    def model(rows: list) -> list:
        return [[sum(1 / (1 + abs(x)) for x in v[j::8]) / 64 for j in range(8)] for v in rows]

    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return J.score(e, model, "embedding", 8).select("vec_id", F.size("p").alias("classes"), F.round(F.array_max("p"), 5).alias("best"))


J3 = "SELECT vec_id, 8 AS classes, round(list_max(list_transform(range(8), lambda j: list_sum(list_transform(range(8), lambda m: 1 / (1 + abs(embedding[j + 8 * m + 1]::DOUBLE)))) / 64)), 5) AS best FROM embeddings"


def j1_mapped_sequences(spark, sf):
    def longest(rows):
        if int(rows["rec"].iloc[0]) % 10 == 3:
            raise ValueError("no decoder")
        return rows[["rec"]].head(1).assign(frames=len(rows))

    return J.map_sequences(frames(spark, sf).select("rec", "i"), longest, "rec bigint, frames bigint, error string")


J1 = f"WITH {FRAMES} SELECT rec, CASE WHEN rec % 10 <> 3 THEN count(*) END AS frames, CASE WHEN rec % 10 = 3 THEN 'task_failed:ValueError' END AS error FROM frames GROUP BY rec"


def j2_authorized(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return J.authorize(c, lambda keys: keys.where("c_custkey % 3 <> 0").withColumn("allowed", F.when(F.col("c_custkey") % 5 != 0, F.col("c_custkey") % 2 == 0)), "c_custkey").select("c_custkey", "authorized")


J2 = "SELECT c_custkey, c_custkey % 3 <> 0 AND c_custkey % 5 <> 0 AND c_custkey % 2 = 0 AS authorized FROM customer"

QUERIES = {
    "d6_confusion": (d6_confusion, f"WITH {CELLS} SELECT * FROM cells"),
    "d7_class_metrics": (d7_class_metrics, f"WITH {CELLS} SELECT label, support, hits, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM full_"),
    "d7_overall_metrics": (d7_overall_metrics, f"WITH {CELLS} SELECT sum(support)::BIGINT AS n, round(sum(hits) / sum(support), 6) AS accuracy, round(avg(f1), 6) AS macro_f1, round(avg(recall) FILTER (support > 0), 6) AS balanced_accuracy FROM full_"),
    "d8_probability_scores": (d8_probability_scores, D8), "d9_reliability": (d9_reliability, D9),
    "d10_risk_coverage": (d10_risk_coverage, D10), "f8_model_choice": (f8_model_choice, F8),
    "f6_threshold": (f6_threshold, F6), "f7_temperature": (f7_temperature, F7), "h11_softmax": (h11_softmax, H11), "b11_decisions": (b11_decisions, B11), "b13_probability_violations": (b13_probability_violations, B13), "b8_feature_view": (b8_feature_view, B8), "b9_vectorized": (b9_vectorized, B9),
    "d4_feature_statistics": (d4_feature_statistics, f"WITH {STATS} SELECT * FROM st"), "d5_standardized": (d5_standardized, D5), "d12_nearest_rank": (d12_nearest_rank, D12),
    "c6_interval_matches": (c6_interval_matches, f"WITH RECURSIVE {MATCHED} SELECT * FROM matches"), "d11_replay_counts": (d11_replay_counts, f"WITH RECURSIVE {COUNTS} SELECT * FROM counts"), "d11_replay_metrics": (d11_replay_metrics, D11B), "c16_ordered_match": (c16_ordered_match, C16), "d13_bootstrap": (d13_bootstrap, D13), "d13_bootstrap_ratios": (d13_bootstrap_ratios, None),
    "d14_strata": (d14_strata, D14), "d15_exclusions": (d15_exclusions, D15), "d17_fold_summary": (d17_fold_summary, f"WITH {FOLDS} SELECT condition, fold, n, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(balanced_accuracy, 6) AS balanced_accuracy FROM summary"), "d18_condition_compare": (d18_condition_compare, D18),
    "d22_throughput": (d22_throughput, D22), "d23_centroids": (d23_centroids, D23), "d23_centroid_scores": (d23_centroid_scores, D23B), "c15_compared_runs": (c15_compared_runs, C15), "m4_group_folds": (m4_group_folds, None), "m4_fold_checks": (m4_fold_checks, M4), "m4_fold_digest": (m4_fold_digest, "SELECT 2 AS runs, count(DISTINCT o_custkey) AS customers FROM orders"), "m5_baselines": (m5_baselines, M5), "m5_logistic": (m5_logistic, None),
    "m7_calibration": (m7_calibration, None), "m8_ablation": (m8_ablation, None), "j1_mapped_sequences": (j1_mapped_sequences, J1), "j2_authorized": (j2_authorized, J2), "j3_scored": (j3_scored, J3),
}
