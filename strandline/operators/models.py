"""Reference classifiers, decisions on probabilities, folds, and the jobs made of them."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import metrics as M


def feature_view(df: DataFrame, vector: str, indices: tuple[int, ...]) -> DataFrame:
    """The vector reduced to the named positions, in that order."""
    return df.withColumn(vector, F.transform(F.array(*map(F.lit, indices)), lambda i: F.get(vector, i)))


def dequantize(df: DataFrame, nested: str, out: str = "vector", scale: int = 1_000_000) -> DataFrame:
    """Frames of integers as one flat vector of doubles."""
    return df.withColumn(out, F.transform(F.flatten(nested), lambda x: x / scale))


def probability_violations(df: DataFrame, key: str, probs: str = "p", length: int | None = None, tolerance: float = 1e-6) -> DataFrame:
    """(rule_id, key): wrong length, values that aren't finite or negative, a sum off 1."""
    from .checks import violations

    total = F.aggregate(F.transform(probs, lambda x: F.coalesce(x, F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    rules = {"bad_value": F.forall(probs, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0) & (x < float("inf"))), "bad_sum": F.abs(total - 1) <= tolerance}
    if length is not None:
        rules["bad_length"] = F.size(probs) == length
    return violations(df, rules, key)


def decide(df: DataFrame, threshold: float, other: int, inactive: Column | None = None, probs: str = "p") -> DataFrame:
    """Adds decision (inactive, abstain, target, other) and reason from calibrated probabilities; a bad vector abstains."""
    ok = F.forall(probs, lambda x: x.isNotNull() & ~F.isnan(x) & (x >= 0)) & (F.size(probs) > 0)
    best = (F.array_position(probs, F.array_max(probs)) - 1).cast("int")
    low = F.array_max(probs) < threshold
    idle = inactive if inactive is not None else F.lit(False)
    decision = F.when(idle, "inactive").when(~F.coalesce(ok, F.lit(False)) | low, "abstain").when(best == other, "other").otherwise("target")
    reason = F.when(idle, "no_event").when(~F.coalesce(ok, F.lit(False)), "invalid_vector").when(low, "below_threshold").otherwise("accepted")
    return df.withColumn("decision", decision).withColumn("reason", reason).withColumn("predicted", F.when(decision.isin("target", "other"), best))


def majority(train: DataFrame, label: str) -> DataFrame:
    """(label): the most frequent class, ties to the first."""
    return train.groupBy(label).agg(F.count("*").alias("_n")).agg(F.max_by(label, F.struct("_n", -F.col(label))).alias(label))


def class_shares(train: DataFrame, label: str) -> DataFrame:
    """(label, n, upto): class counts and their running total by class; one row per class."""
    n = train.groupBy(label).agg(F.count("*").alias("n"))
    return n.withColumn("upto", F.sum("n").over(Window.orderBy(label).rowsBetween(Window.unboundedPreceding, 0)))


def stratified_random(df: DataFrame, shares: DataFrame, key: str, label: str, seed: int) -> DataFrame:
    """Adds predicted: a class drawn by a hash of (seed, key) in proportion to the class counts."""
    one = shares.agg(F.sort_array(F.collect_list(F.struct("upto", label))).alias("_s"), F.sum("n").alias("_all"))
    draw = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint")
    joined = df.crossJoin(F.broadcast(one)).withColumn("_d", draw % F.col("_all"))
    return joined.withColumn("predicted", F.get(F.filter("_s", lambda x: x["upto"] > F.col("_d")), F.lit(0))[label]).drop("_s", "_all", "_d")


def fit_logistic(train: DataFrame, vector: str, label: str, c: float, iterations: int = 100):
    """A multinomial logistic regression of inverse regularization c; regParam = 1 / (c n)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    data = train.select(array_to_vector(F.col(vector).cast("array<double>")).alias("features"), F.col(label).cast("double").alias("label"))
    return LogisticRegression(family="multinomial", regParam=1 / (c * max(1, data.count())), standardization=False, maxIter=iterations).fit(data)


def predict_logistic(model, df: DataFrame, vector: str) -> DataFrame:
    """Adds p, the class probabilities."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    scored = model.transform(df.withColumn("features", array_to_vector(F.col(vector).cast("array<double>"))))
    return scored.withColumn("p", vector_to_array("probability")).drop("features", "rawPrediction", "probability", "prediction")


def choose_model(scores: DataFrame, c: str = "c", score: str = "macro_f1") -> DataFrame:
    """(c, score) of the best score, ties to the smaller c; NULLs if there are none."""
    return scores.agg(F.min_by(F.struct(c, score), F.struct(-F.col(score), F.col(c))).alias("b")).select("b.*")


def validation_scores(predictions: dict[float, DataFrame], label: str, labels: list) -> DataFrame:
    """(c, macro_f1): one row per candidate from its predictions (label, predicted); the grid is the model's, not the data's."""
    each = [M.overall_metrics(M.class_metrics(M.confusion(df, label, "predicted", labels))).select(F.lit(float(c)).alias("c"), "macro_f1") for c, df in predictions.items()]
    return reduce(DataFrame.unionByName, each)


def fit_logistic_grid(train: DataFrame, validation: DataFrame, vector: str, label: str, labels: list, grid: tuple[float, ...] = (0.1, 1.0, 10.0), iterations: int = 100):
    """(model, scores): a fit for each c, scored by macro F1 on validation rows; the model is that of choose_model."""
    models = {c: fit_logistic(train, vector, label, c, iterations) for c in grid}
    scores = validation_scores({c: M.top(predict_logistic(m, validation, vector)) for c, m in models.items()}, label, labels)
    scores = train.sparkSession.createDataFrame(scores.collect(), scores.schema)  # a row for each c
    return models[choose_model(scores).first()["c"]], scores


def score(df: DataFrame, model: Callable[[list], list], vector: str, classes: int) -> DataFrame:
    """Adds p by a batch function from lists of vectors to lists of probabilities (for example an inference session)."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField("p", T.ArrayType(T.DoubleType()))])

    def run(batches):
        for rows in batches:
            rows["p"] = [list(map(float, x)) for x in model(rows[vector].tolist())] if len(rows) else pd.Series(dtype=object)
            yield rows

    return df.mapInPandas(run, schema)


def map_sequences(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str, entity: str = "rec") -> DataFrame:
    """A function per sequence; one that raises gives a row of NULLs with error `task_failed:<kind>` instead of a failed job. schema ends with error string."""
    names = [part.split()[0] for part in schema.split(", ")]

    def guarded(rows: pd.DataFrame) -> pd.DataFrame:
        try:
            return fn(rows).assign(error=None)[names]
        except Exception as e:  # noqa: BLE001 - reported as data
            return pd.DataFrame([{**dict.fromkeys(names), entity: rows[entity].iloc[0], "error": f"task_failed:{type(e).__name__}"}])[names]

    return df.groupBy(entity).applyInPandas(guarded, schema)


def authorize(df: DataFrame, verifier: Callable[[DataFrame], DataFrame], key: str) -> DataFrame:
    """Adds authorized by a verifier from rows to (key, allowed); no answer and NULL are a refusal."""
    said = verifier(df.select(key).distinct()).groupBy(F.col(key).alias("_k")).agg(F.bool_and(F.coalesce("allowed", F.lit(False))).alias("_a"))
    return df.join(said, F.col(key) == F.col("_k"), "left").withColumn("authorized", F.coalesce("_a", F.lit(False))).drop("_k", "_a")


def calibrate(scored: DataFrame) -> DataFrame:
    """One row: temperature, log loss and Brier score before and after, chosen threshold and coverage."""
    temperature = M.fit_temperature(scored).first()
    after = M.apply_temperature(scored, temperature["temperature_milli"] / 1000)
    before_, after_ = M.probability_scores(scored), M.probability_scores(after)
    chosen = M.choose_threshold(M.risk_coverage(M.top(after)))
    row = before_.select(F.col("log_loss").alias("log_loss_before"), F.col("brier").alias("brier_before")).crossJoin(after_.select(F.col("log_loss").alias("log_loss_after"), F.col("brier").alias("brier_after"))).crossJoin(chosen)
    return row.withColumn("temperature_milli", F.lit(temperature["temperature_milli"]))
