"""Decision histories, labels, runs, and other record rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checks import violations


def project_annotations(decisions: DataFrame, key: str, order: str, proposal: str) -> DataFrame:
    """One final row per annotation: the last proposal, and the review status by how many decided."""
    last = decisions.groupBy(key).agg(F.max_by(proposal, order).alias("label"), F.count("*").alias("decisions"))
    status = F.when(F.col("decisions") == 1, "draft").when(F.col("decisions") == 2, "reviewed").otherwise("adjudicated")
    final = last.withColumn("review_status", status)
    return final.withColumn("eligible", F.col("label").isNotNull() & (F.col("review_status") != "draft"))


def annotation_violations(decisions: DataFrame, key: str, order: str, role: str, actor: str, at: str, roles: tuple[str, ...] = ("annotator", "reviewer", "adjudicator")) -> DataFrame:
    """(rule_id, key): roles out of order, an actor twice, times that don't rise, more decisions than roles."""
    w = Window.partitionBy(key).orderBy(order)
    expected = F.element_at(F.array(*map(F.lit, roles)), F.least(F.col("_k"), F.lit(len(roles))))
    marked = decisions.withColumn("_k", F.row_number().over(w)).withColumn("_at", F.lag(at).over(w))
    each = marked.groupBy(key).agg(F.bool_and(F.col(role) == expected).alias("_roles"), F.bool_and(F.col("_at").isNull() | (F.col(at) > F.col("_at"))).alias("_times"), F.count_distinct(actor).alias("_actors"), F.count("*").alias("_n"))
    return violations(each, {"role_order": F.col("_roles"), "time_not_rising": F.col("_times"), "actor_twice": F.col("_actors") == F.col("_n"), "too_many": F.col("_n") <= len(roles)}, key)


def normalize_labels(df: DataFrame, column: str, aliases: DataFrame, quarantined: tuple[str, ...] = ()) -> DataFrame:
    """Adds label and label_status: approved (by the alias table), quarantined, missing or unknown; nothing is guessed."""
    a = aliases.select(F.col("alias").alias("_alias"), F.col("label"))
    joined = df.join(a, F.lower(F.trim(F.col(column))) == F.col("_alias"), "left")
    status = F.when(F.col(column).isNull(), "missing").when(F.col(column).isin(*quarantined), "quarantined").when(F.col("label").isNotNull(), "approved").otherwise("unknown")
    return joined.withColumn("label_status", status).withColumn("label", F.when(F.col("label_status") == "approved", F.col("label"))).drop("_alias")


def label_count_violations(df: DataFrame, column: str, labels: tuple[str, ...]) -> DataFrame:
    """(label, count, problem): classes without rows and labels that aren't in the vocabulary."""
    known = df.sparkSession.createDataFrame([(x,) for x in labels], "_label string")
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    both = counts.join(known, F.col(column) == F.col("_label"), "full")
    problem = F.when(F.col("_label").isNull(), "unknown_label").when(F.col("n").isNull(), "no_rows")
    return both.select(F.coalesce(column, "_label").alias("label"), F.coalesce("n", F.lit(0).cast("bigint")).alias("n"), problem.alias("problem")).where("problem IS NOT NULL")


def privacy_violations(df: DataFrame, patterns: dict[str, str], key: str, *columns: str) -> DataFrame:
    """(rule_id, key) of rows in which any of the text columns matches a forbidden pattern."""
    text = F.concat_ws("\n", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns))
    return violations(df.select(key, text.alias("_text")), {name: ~F.col("_text").rlike(p) for name, p in patterns.items()}, key)


def redact(df: DataFrame, patterns: dict[str, str], column: str) -> DataFrame:
    """Replaces every match by <name of the pattern>."""
    out: Column = F.col(column)
    for name, pattern in patterns.items():
        out = F.regexp_replace(out, pattern, f"<{name}>")
    return df.withColumn(column, out)


def run_violations(runs: DataFrame, key: str) -> DataFrame:
    """(rule_id, key): success without outputs or with a failure code, failure without one, an end before the start."""
    ok = F.col("status") == "success"
    return violations(runs, {"success_without_output": ~ok | (F.col("outputs") > 0), "success_with_failure": ~ok | F.col("failure").isNull(), "failure_without_code": ok | F.col("failure").isNotNull(), "ends_early": F.col("finished") >= F.col("started")}, key)


def metric_key_violations(metrics: DataFrame, run: str, order: str, key: str) -> DataFrame:
    """(rule_id, run, order): metrics of a run whose key repeats the one before or sorts before it; NULL keys are left out, rows that share a place are taken by their keys."""
    marked = metrics.where(F.col(key).isNotNull()).withColumn("_before", F.lag(key).over(Window.partitionBy(run).orderBy(order, key)))
    first = F.col("_before").isNull()
    return violations(marked, {"key_repeated": first | (F.col(key) != F.col("_before")), "key_unsorted": first | (F.col(key) >= F.col("_before"))}, run, order)


def reconcile(left: DataFrame, right: DataFrame, on: str, identity: dict[str, str]) -> DataFrame:
    """(on, status, differs): rows of left matched to right, missing there, or with the names of the columns that disagree."""
    r = right.select(F.col(on).alias("_on"), *(F.col(b).alias(f"_r_{b}") for b in identity.values()))
    joined = left.join(r, F.col(on) == F.col("_on"), "left")
    odd = F.array_join(F.array_compact(F.array(*(F.when(~F.col(a).eqNullSafe(F.col(f"_r_{b}")), F.lit(a)) for a, b in identity.items()))), ",")
    missing = F.col("_on").isNull()
    return joined.select(on, F.when(missing, "missing").when(odd == "", "matched").otherwise("differs").alias("status"), F.when(~missing, odd).otherwise("").alias("differs"))
