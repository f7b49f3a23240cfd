"""Evaluation metrics: everything after one aggregation of the facts runs on rows as few as the classes, bins or groups."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio_half_away, temperature_softmax
from ..sources.staging import written


def inventory_digest(df: DataFrame, key: str, item: str, bucket: int = 4096) -> DataFrame:
    """(digest, items): SHA-256 over the items in key order, in two levels (runs of `bucket` keys, then those) so that no string holds all.

    Keys are integers; the second level has one digest per run.
    """
    runs = df.groupBy(F.floor(F.col(key) / bucket).cast("bigint").alias("_b")).agg(F.sha2(F.expr(f"listagg({item}, ',') WITHIN GROUP (ORDER BY {key})"), 256).alias("_d"), F.count("*").alias("_n"))
    return runs.agg(F.sha2(F.expr("listagg(_d, ',') WITHIN GROUP (ORDER BY _b)"), 256).alias("digest"), F.sum("_n").alias("items"))


def confusion(df: DataFrame, actual: str, predicted: str, labels: list) -> DataFrame:
    """(actual, predicted, n) for every pair of the given labels, zero cells included. The labels are the vocabulary, not data."""
    kind = df.schema[actual].dataType
    each = df.sparkSession.createDataFrame([(x,) for x in labels], f"l {kind.simpleString()}")
    cells = each.select(F.col("l").alias("_a")).crossJoin(F.broadcast(each.select(F.col("l").alias("_p"))))
    n = df.groupBy(actual, predicted).agg(F.count("*").alias("n"))
    joined = cells.join(n, (F.col("_a") == F.col(actual)) & (F.col("_p") == F.col(predicted)), "left")
    return joined.select(F.col("_a").alias("actual"), F.col("_p").alias("predicted"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n"))


def _safe(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def class_metrics(cells: DataFrame, *by: str) -> DataFrame:
    """Per class (and by): support, precision, recall and F1 from confusion cells; 0/0 is 0."""
    own = F.sum(F.when(F.col("actual") == F.col("predicted"), F.col("n")).otherwise(0))
    side = cells.groupBy(*by, F.col("actual").alias("label")).agg(F.sum("n").alias("support"), own.alias("hits"))
    said = cells.groupBy(*by, F.col("predicted").alias("label")).agg(F.sum("n").alias("said"))
    joined = side.join(said, [*by, "label"]).withColumn("precision", _safe(F.col("hits"), F.col("said"))).withColumn("recall", _safe(F.col("hits"), F.col("support")))
    return joined.withColumn("f1", _safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select(*by, "label", "support", "hits", "precision", "recall", "f1")


def overall_metrics(classes: DataFrame, *by: str) -> DataFrame:
    """(by, n, accuracy, macro_f1, balanced_accuracy): the balanced accuracy is over classes that have rows."""
    aggs = (F.sum("support").alias("n"), _safe(F.sum("hits"), F.sum("support")).alias("accuracy"), F.avg("f1").alias("macro_f1"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"))
    return classes.groupBy(*by).agg(*aggs) if by else classes.agg(*aggs)


def true_probability(probs: str = "p", label: str = "label") -> Column:
    return F.get(probs, F.col(label))


def probability_scores(df: DataFrame, probs: str = "p", label: str = "label", floor: float = 1e-12) -> DataFrame:
    """(log_loss, brier) means."""
    brier = F.aggregate(F.transform(probs, lambda x, k: F.pow(x - (k == F.col(label)).cast("double"), 2)), F.lit(0.0), lambda a, x: a + x)
    return df.agg(F.avg(-F.log(F.least(F.greatest(true_probability(probs, label), F.lit(floor)), F.lit(1.0)))).alias("log_loss"), F.avg(brier).alias("brier"))


def top(df: DataFrame, probs: str = "p") -> DataFrame:
    """Adds confidence and predicted (the first of equal largest)."""
    return df.withColumn("confidence", F.array_max(probs)).withColumn("predicted", (F.array_position(probs, F.array_max(probs)) - 1).cast("int"))


def reliability(df: DataFrame, bins: int = 10, label: str = "label") -> DataFrame:
    """(bin, n, confidence, accuracy, gap) over equal bins of confidence, the last closed; empty bins included."""
    b = F.least(F.floor(F.col("confidence") * bins), F.lit(bins - 1)).cast("int")
    got = df.groupBy(b.alias("_b")).agg(F.count("*").alias("n"), F.avg("confidence").alias("confidence"), F.avg((F.col("predicted") == F.col(label)).cast("double")).alias("accuracy"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    joined = every.join(got, F.col("bin") == F.col("_b"), "left")
    return joined.select("bin", F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), "confidence", "accuracy", F.abs(F.col("confidence") - F.col("accuracy")).alias("gap"))


def risk_coverage(df: DataFrame, label: str = "label", target: Column | None = None, said_target: Column | None = None) -> DataFrame:
    """(percent, accepted, errors, coverage, risk) for thresholds 0..100 %: rows with confidence >= percent / 100 are accepted.

    With target (the row's class is one) and said_target (the predicted one is): accepted and correct targets over all targets, the accepted targets'
    accuracy and errors; of the other rows the share abstained from, the share not accepted as a target, and that accepted as one. Shares of nothing
    are NULL. Facts are combined into 101 integer buckets first, and suffix sums over those give all thresholds.
    """
    near = F.greatest(F.lit(0), F.least(F.floor(F.col("confidence") * 100), F.lit(100))).cast("int")
    # the product can fall on the other side of a threshold than the quotient does
    bucket = near + F.when((near < 100) & (F.col("confidence") >= (near + 1) / 100), 1).when(F.col("confidence") < near / 100, -1).otherwise(0)
    t, said, right = (target if target is not None else F.lit(True)), (said_target if said_target is not None else F.lit(True)), F.col("predicted") == F.col(label)
    counts = {"n": F.lit(True), "errors": ~right, "t": t, "t_right": t & right, "t_wrong": t & ~right, "f": ~t, "f_said": ~t & said}
    got = df.groupBy(bucket.alias("_b")).agg(*(F.count_if(c).alias(f"_{k}") for k, c in counts.items()))
    every = df.sparkSession.range(-1, 101).select(F.col("id").cast("int").alias("percent")).join(got, F.col("percent") == F.col("_b"), "left")
    after = Window.orderBy("percent").rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy("percent").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    own = {k: F.coalesce(F.col(f"_{k}"), F.lit(0).cast("bigint")) for k in counts}
    summed = every.select("percent", *(F.sum(c).over(after).alias(k) for k, c in own.items()), *(F.sum(own[k]).over(whole).alias(f"all_{k}") for k in ("n", "t", "f"))).where("percent >= 0")
    share = lambda n, d: F.when(F.col(d) > 0, F.col(n) / F.col(d))
    basic = ["percent", F.col("n").alias("accepted"), "errors", _safe(F.col("n"), F.col("all_n")).alias("coverage"), share("errors", "n").alias("risk")]
    if target is None or said_target is None:
        return summed.select(*basic)
    return summed.select(
        *basic, share("t", "all_t").alias("target_coverage"), share("t_right", "all_t").alias("correct_target_coverage"), share("t_right", "t").alias("target_accuracy"), F.col("t_wrong").alias("target_errors"),
        (1 - share("f", "all_f")).alias("abstention_rate"), (1 - share("f_said", "all_f")).alias("non_target_rate"), share("f_said", "all_f").alias("false_acceptance"),
    )


def choose_threshold(curve: DataFrame) -> DataFrame:
    """(status, percent, coverage): of thresholds without an error and with coverage, that of most coverage, ties to the smallest.

    On a curve with targets (status, percent, coverage, correct_target_coverage): correct targets have to be covered, and their coverage counts first.
    """
    first = ["correct_target_coverage"] if "correct_target_coverage" in curve.columns else []
    ok = (F.col("errors") == 0) & (F.col("accepted") > 0)
    for c in first:
        ok = ok & (F.col(c) > 0)
    rank = F.struct(*(-F.col(c) for c in first), -F.col("coverage"), F.col("percent"))
    best = curve.agg(F.min_by(F.struct("percent", "coverage", *first), F.when(ok, rank)).alias("b")).select("b.*")
    return best.select(F.when(F.col("percent").isNull(), "no_viable_operating_point").otherwise("selected").alias("status"), "percent", "coverage", *first)


def fit_temperature(df: DataFrame, low: int = 50, high: int = 10_000, probs: str = "p", label: str = "label", floor: float = 1e-12) -> DataFrame:
    """(temperature_milli, log_loss): the least mean log loss over every thousandth from low to high; ties to the nearest 1, then the smaller.

    The loss is cut at -ln(floor), so it needn't be convex, and the whole grid is evaluated: each partition sums the
    losses of its rows for all grid values in one pass, and those sums, one row per grid value, are added. No rows give none.
    """
    grid = np.arange(low, high + 1)
    sharp, most = 1000.0 / grid, -math.log(floor)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows = np.zeros(len(grid)), 0
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                z = np.log(np.maximum(np.array(part.column(0).to_pylist(), float), floor))
                z -= z.max(1, keepdims=True)
                own = z[np.arange(len(z)), part.column(1).to_numpy()]
                loss = np.zeros((len(z), len(grid)))
                for c in range(z.shape[1]):
                    loss += np.exp(z[:, c, None] * sharp)
                total += np.minimum(np.log(loss) - own[:, None] * sharp, most).sum(0)
                rows += len(z)
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(grid), pa.array(total), pa.array(np.full(len(grid), rows))], names=["g", "total", "n"])

    added = df.select(probs, F.col(label).cast("int")).mapInArrow(sums, "g bigint, total double, n bigint").groupBy("g").agg((F.sum("total") / F.sum("n")).alias("log_loss"))
    best = added.agg(F.min(F.struct(F.col("log_loss"), F.abs(F.col("g") - 1000), F.col("g"))).alias("b")).where("b IS NOT NULL")
    return best.select(F.col("b.g").cast("int").alias("temperature_milli"), F.col("b.log_loss").alias("log_loss"))


def apply_temperature(df: DataFrame, temperature: float, probs: str = "p") -> DataFrame:
    return df.withColumn(probs, temperature_softmax(F.col(probs), temperature))


def nearest_rank(df: DataFrame, column: str, percents: tuple[int, ...], *by: str) -> DataFrame:
    """p50, p95, …: the element at ceil(p n / 100) of the sorted values of each group; nulls don't count, and a group of nulls only has NULLs.

    Equal values are counted, and the counts dealt to ranges of (group, value). Sums of ranges tell which range holds a rank, and only
    such ranges are walked in order, so neither a group nor its values need to fit a task.
    """
    keys = [F.col(c).alias(f"_b{k}") for k, c in enumerate(by)]
    names = [f"_b{k}" for k in range(len(by))]
    counted = df.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_v")).agg(F.count("*").alias("_c"))
    ranged = written(written(counted, "rank-counts").repartitionByRange(*names, "_v").withColumn("_range", F.spark_partition_id()), "rank-ranges")
    sums = ranged.groupBy(*names, "_range").agg(F.sum("_c").alias("_n"))
    w = Window.partitionBy(*names).orderBy("_range")
    placed = sums.withColumn("_start", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_all", F.sum("_n").over(Window.partitionBy(*names)))
    ranks = F.array(*(F.struct(F.lit(p).alias("p"), F.greatest(F.call_function("div", F.col("_all") * p + 99, F.lit(100)), F.lit(1)).alias("r")) for p in percents))
    wanted = placed.withColumn("_ranks", F.filter(ranks, lambda x: (x["r"] > F.col("_start")) & (x["r"] <= F.col("_start") + F.col("_n")))).where(F.size("_ranks") > 0)
    wanted = wanted.select("_range", "_start", "_ranks", *(F.col(c).alias(f"_w{c}") for c in names))
    same = F.col("_range") == F.col("_wanted_range")
    for c in names:
        same = same & F.col(c).eqNullSafe(F.col(f"_w{c}"))
    held = ranged.join(F.broadcast(wanted.withColumnRenamed("_range", "_wanted_range")), same)
    until = F.col("_start") + F.sum("_c").over(Window.partitionBy(*names, "_range").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0))
    hit = held.withColumn("_until", until).withColumn("_rank", F.explode("_ranks")).where((F.col("_rank.r") <= F.col("_until")) & (F.col("_rank.r") > F.col("_until") - F.col("_c")))
    found = hit.groupBy(*names).agg(*(F.max(F.when(F.col("_rank.p") == p, F.col("_v"))).alias(f"p{p}") for p in percents))
    if not by:
        return found
    groups = df.select(*keys).distinct().select(*(F.col(c).alias(f"_g{c}") for c in names))
    match = F.lit(True)
    for c in names:
        match = match & F.col(c).eqNullSafe(F.col(f"_g{c}"))
    return groups.join(found, match, "left").select(*(F.col(f"_g_b{k}").alias(c) for k, c in enumerate(by)), *(f"p{p}" for p in percents))


def group_bootstrap(counts: DataFrame, group: str, hits: str, total: str, rounds: int, seed: int) -> DataFrame:
    """(groups, low, high): 2.5 and 97.5 % nearest ranks of hits/total over rounds that draw groups with replacement.

    Rows of counts are summed by group first and written, so the draws work on as many rows as there are groups; a draw is a hash of
    (seed, round, place) that other engines can take too. Groups are numbered inside ranges, each starting after those before it.
    Fewer than two groups give NULL bounds.
    """
    summed = counts.groupBy(group).agg(F.sum(hits).alias("_h"), F.sum(total).alias("_t")).repartitionByRange(group)
    ranged = written(summed.withColumn("_range", F.spark_partition_id()), "bootstrap-groups")
    before = F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = ranged.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", F.coalesce(before, F.lit(0)).alias("_start"))
    n = ranged.count()
    if n < 2:
        return counts.sparkSession.createDataFrame([(n, None, None)], "groups bigint, low double, high double")
    place = F.row_number().over(Window.partitionBy("_range").orderBy(group))
    numbered = ranged.withColumn("_p", place).join(F.broadcast(starts), "_range").select((F.col("_p") + F.col("_start") - 1).alias("_k"), "_h", "_t")
    draws = counts.sparkSession.range(rounds * n).select(F.floor(F.col("id") / n).alias("_r"), (F.col("id") % n).alias("_j"))
    pick = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("_r").cast("string"), F.col("_j").cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint") % n
    # how often a round draws a group, combined before the join
    drawn = draws.select("_r", pick.alias("_p")).groupBy("_r", "_p").agg(F.count("*").alias("_c"))
    rounds_ = drawn.join(numbered, F.col("_p") == F.col("_k")).groupBy("_r").agg((F.sum(F.col("_h") * F.col("_c")) / F.sum(F.col("_t") * F.col("_c"))).alias("_v"))
    return rounds_.agg(F.lit(n).cast("bigint").alias("groups"), F.expr("percentile_disc(0.025) WITHIN GROUP (ORDER BY _v)").alias("low"), F.expr("percentile_disc(0.975) WITHIN GROUP (ORDER BY _v)").alias("high"))


def strata(df: DataFrame, actual: str, predicted: str, *dimensions: str) -> DataFrame:
    """(dimension, value, n, errors): failures by each dimension alone, in one pass."""
    items = F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value")) for d in dimensions))
    return df.select(F.explode(items).alias("x"), (F.col(actual) != F.col(predicted)).alias("_e")).groupBy("x.dimension", "x.value").agg(F.count("*").alias("n"), F.count_if("_e").alias("errors"))


def fold_summary(df: DataFrame, labels: list, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """(condition, fold, n, accuracy, macro_f1, balanced_accuracy) of each fold and, with fold NULL, of all folds pooled."""
    pooled = df.select("condition", F.lit(None).cast("int").alias("fold"), actual, predicted)
    cells = df.select("condition", F.col("fold").cast("int").alias("fold"), actual, predicted).unionByName(pooled).groupBy("condition", "fold", actual, predicted).agg(F.count("*").alias("n"))
    each = df.sparkSession.createDataFrame([(x,) for x in labels], f"label {df.schema[actual].dataType.simpleString()}")
    keys = cells.select("condition", "fold").distinct().crossJoin(F.broadcast(each))
    same = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    hit = keys.alias("k").join(cells.alias("c"), F.col("k.condition").eqNullSafe(F.col("c.condition")) & F.col("k.fold").eqNullSafe(F.col("c.fold")), "left")
    a, p, label = F.col(f"c.{actual}"), F.col(f"c.{predicted}"), F.col("k.label")
    per = hit.groupBy("k.condition", "k.fold", "k.label").agg(same(a == label).alias("support"), same((a == label) & (p == label)).alias("hits"), same(p == label).alias("said"))
    per = per.withColumn("precision", _safe(F.col("hits"), F.col("said"))).withColumn("recall", _safe(F.col("hits"), F.col("support")))
    per = per.withColumn("f1", _safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return overall_metrics(per, "condition", "fold")


def compare_conditions(summary: DataFrame, base: str, other: str, least: float) -> DataFrame:
    """(verdict, gain): supported if every fold improves and the pooled gain reaches `least`; unsupported if all are worse or the gain is small; else inconclusive."""
    a = summary.where(F.col("condition") == base).select(F.col("fold").alias("f"), F.col("macro_f1").alias("a"))
    b = summary.where(F.col("condition") == other).select("fold", F.col("macro_f1").alias("b"))
    both = a.join(b, F.col("f").eqNullSafe(F.col("fold"))).withColumn("d", F.col("b") - F.col("a"))
    in_fold = F.col("fold").isNotNull()
    found = both.agg(F.bool_and(F.when(in_fold, F.col("d") > 0)).alias("better"), F.bool_and(F.when(in_fold, F.col("d") < 0)).alias("worse"), F.max(F.when(~in_fold, F.col("d"))).alias("gain"))
    verdict = F.when(F.col("better") & (F.col("gain") >= least), "supported").when(F.col("worse") | F.col("better"), "unsupported").otherwise("inconclusive")
    return found.select(verdict.alias("verdict"), F.col("gain"))


def fit_statistics(features: DataFrame, vector: str, mask: str | None = None, scale: int = 1_000_000) -> DataFrame:
    """(feature, n, mean, sd) of quantized integers: mean half away from zero, the population's deviation rounded exactly; (0, scale) without values.

    Sums are decimals, so no order of addition matters; the square root is estimated and corrected on integers.
    """
    dec = "decimal(38,0)"
    values = features.select(F.posexplode(vector).alias("feature", "v"), *([F.col(mask)] if mask else []))
    if mask:
        values = values.where(F.get(mask, F.col("feature")))
    s = values.groupBy("feature").agg(F.count("v").alias("n"), F.sum(F.col("v").cast(dec)).cast(dec).alias("s"), F.sum((F.col("v").cast("decimal(19,0)") * F.col("v").cast("decimal(19,0)")).cast(dec)).cast(dec).alias("q"))
    mean = F.expr("CASE WHEN s < 0 THEN -CAST((2 * -s + n) div (2 * n) AS BIGINT) ELSE CAST((2 * s + n) div (2 * n) AS BIGINT) END")
    root = F.expr("CAST(sqrt(CAST(n * q - s * s AS DOUBLE)) / n AS DOUBLE)")
    # nearest integer r to sqrt(V)/n: (2r - 1)^2 n^2 <= 4 V < (2r + 1)^2 n^2
    est = s.withColumn("mean", mean).withColumn("_r", F.floor(root + 0.5).cast("bigint"))
    v4, sq = "4 * (n * q - s * s)", "CAST((2 * {} {} 1) AS DECIMAL(19,0)) * (2 * {} {} 1) * n * n"
    fixed = F.expr(f"CASE WHEN _r > 0 AND {sq.format('_r', '-', '_r', '-')} > {v4} THEN _r - 1 WHEN {sq.format('_r', '+', '_r', '+')} <= {v4} THEN _r + 1 ELSE _r END")
    sd = F.when((F.col("n") == 0) | (F.expr("n * q - s * s") == 0), scale).otherwise(F.greatest(fixed, F.lit(1)))
    return est.select(F.col("feature").cast("int").alias("feature"), "n", "mean", sd.cast("bigint").alias("sd"))


def apply_statistics(features: DataFrame, statistics: DataFrame, vector: str, scale: int = 1_000_000) -> DataFrame:
    """Replaces the vector by (v - mean) scale / sd, halves away from zero; the statistics are one broadcast array row per feature."""
    one = statistics.agg(F.sort_array(F.collect_list(F.struct("feature", "mean", "sd"))).alias("_s"))

    def z(v: Column, k: Column) -> Column:
        st = F.get("_s", k)
        n = (v - st["mean"]) * F.lit(scale).cast("bigint")
        return ratio_half_away(n, st["sd"])

    return features.crossJoin(F.broadcast(one)).withColumn(vector, F.transform(vector, z)).drop("_s")


def fit_centroids(df: DataFrame, vector: str, label: str) -> DataFrame:
    """(label, centroid): the mean vector of each class."""
    each = df.select(label, F.posexplode(vector).alias("k", "x")).groupBy(label, "k").agg(F.avg("x").alias("m"))
    return each.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "m"))), lambda x: x["m"]).alias("centroid"))


def score_centroids(df: DataFrame, centroids: DataFrame, vector: str, label: str) -> DataFrame:
    """Adds scores (class order): 2 c.x - |c|^2, and predicted, the class of the largest. The classes are one broadcast row."""
    one = centroids.agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("l"), F.col("centroid").alias("c")))).alias("_c"))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    scored = df.crossJoin(F.broadcast(one)).withColumn("scores", F.transform("_c", lambda e: 2 * dot(F.col(vector), e["c"]) - dot(e["c"], e["c"])))
    return scored.withColumn("predicted", F.get("_c", (F.array_position("scores", F.array_max("scores")) - 1).cast("int"))["l"]).drop("_c")


def compare_runs(a: DataFrame, b: DataFrame, key: str, probs: str, absolute: float, relative: float, threshold: float = 0.0) -> DataFrame:
    """(key, max_difference, within, same_class, same_decision) of rows scored by two runtimes; a decision is the class, or none below the threshold."""
    other = b.select(F.col(key).alias("_k"), F.col(probs).alias("_q"))
    joined = a.join(other, F.col(key) == F.col("_k"))
    gap = F.array_max(F.zip_with(probs, "_q", lambda x, y: F.abs(x - y)))
    within = F.forall(F.zip_with(probs, "_q", lambda x, y: F.abs(x - y) <= absolute + relative * F.abs(y)), lambda ok: ok)
    arg = lambda c: F.array_position(c, F.array_max(c))
    decided = lambda c: F.when(F.array_max(c) >= threshold, arg(c))
    return joined.select(key, gap.alias("max_difference"), within.alias("within"), (arg(probs) == arg("_q")).alias("same_class"), decided(probs).eqNullSafe(decided("_q")).alias("same_decision"))


def throughput(events: DataFrame, at: str, width: str, processed: Column, dropped: Column, task_ms: Column | None = None, long_ms: int = 50) -> DataFrame:
    """(start, processed, dropped, drop_ppm) per tumbling window, and with task_ms the number, sum and maximum of tasks longer than long_ms; batch and streaming alike."""
    aggs = [F.count_if(processed).alias("processed"), F.count_if(dropped).alias("dropped")]
    more = []
    if task_ms is not None:
        late = F.when(task_ms > long_ms, task_ms)
        zero = F.lit(0).cast("bigint")
        aggs += [F.count(late).alias("long_tasks"), F.sum(late).alias("_sum"), F.max(late).alias("_max")]
        more = ["long_tasks", F.coalesce("_sum", zero).alias("long_ms"), F.coalesce("_max", zero).alias("longest_ms")]
    w = events.groupBy(F.window(at, width).alias("w")).agg(*aggs)
    return w.select(F.col("w.start").alias("start"), "processed", "dropped", F.floor(F.col("dropped") * 1_000_000 / (F.col("processed") + F.col("dropped")) + 0.5).cast("bigint").alias("drop_ppm"), *more)
