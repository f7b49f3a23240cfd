"""Consent as an event log: what was known to be complete at a time, who was covered then, and for which purpose."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .checks import violations


def scope_hash(permissions: tuple[str, ...]) -> Column:
    """SHA-256 of the permissions in order of their names, as name=true or name=false; a null permission is false."""
    shown = [F.concat(F.lit(f"{p}="), F.coalesce(F.col(p), F.lit(False)).cast("string")) for p in sorted(permissions)]
    return F.sha2(F.concat_ws("\n", *shown), 256)


def judged_log(log: DataFrame, marks: DataFrame) -> DataFrame:
    """Adds late to log (receipt_id, event, occurred_at, recorded_at): whether a mark recorded before the entry had said that the log is complete through a time at or after its event.

    marks: (receipt_id, complete_through, recorded_at). An entry recorded together with a mark isn't late by it. One union and one sort by receipt.
    """
    w = Window.partitionBy("receipt_id").orderBy("recorded_at", "_o").rowsBetween(Window.unboundedPreceding, -1)
    both = log.select("receipt_id", "recorded_at", F.struct("*").alias("_e"), F.lit(0).alias("_o")).unionByName(marks.select("receipt_id", "recorded_at", F.col("complete_through").alias("_m"), F.lit(1).alias("_o")), allowMissingColumns=True)
    told = both.withColumn("_told", F.max("_m").over(w)).where("_e IS NOT NULL")
    return told.select("_e.*", F.coalesce(F.col("_told") >= F.col("_e.occurred_at"), F.lit(False)).alias("late"))


def states_at(asked: DataFrame, log: DataFrame, marks: DataFrame, at: str, key: str) -> DataFrame:
    """(key, state): granted, ended, none (no event by then) or unknown (the log isn't complete through the time) for each asked (key, receipt_id, at).

    The last event at or before the time counts, of several at one time an ending one; late entries don't. So what is said of a time before a mark stays.
    """
    good = judged_log(log, marks).where("NOT late")
    events = good.select("receipt_id", F.col("occurred_at").alias("_x"), F.when(F.col("event") == "granted", 0).otherwise(1).alias("_o"), F.when(F.col("event") == "granted", "granted").otherwise("ended").alias("_s"))
    through = marks.groupBy("receipt_id").agg(F.max("complete_through").alias("_through"))
    points = asked.select("receipt_id", F.col(at).alias("_x"), F.lit(2).alias("_o"), F.struct(key).alias("_k"))
    w = Window.partitionBy("receipt_id").orderBy("_x", "_o").rowsBetween(Window.unboundedPreceding, -1)
    met = events.unionByName(points, allowMissingColumns=True).withColumn("_last", F.last("_s", ignorenulls=True).over(w)).where("_k IS NOT NULL")
    joined = met.join(through, "receipt_id", "left")
    known = F.coalesce(F.col("_through") >= F.col("_x"), F.lit(False))
    return joined.select(f"_k.{key}", F.when(~known, "unknown").otherwise(F.coalesce("_last", F.lit("none"))).alias("state"))


def _with_receipts(grants: DataFrame, receipts: DataFrame, permissions: tuple[str, ...]) -> DataFrame:
    fields = ("participant_id", "purpose_id", "study_id", "taxonomy", "granted_at", "valid_until", *permissions)
    r = receipts.withColumn("_hash", scope_hash(permissions)).select(F.col("receipt_id").alias("_r"), "_hash", *(F.col(c).alias(f"_{c}") for c in fields))
    return grants.join(r, F.col("receipt_id") == F.col("_r"), "left")


def receipt_grant_violations(grants: DataFrame, receipts: DataFrame, log: DataFrame, marks: DataFrame, permissions: tuple[str, ...]) -> DataFrame:
    """(rule_id, grant_id): what a grant doesn't share with its receipt (participant, purpose, study, taxonomy, scope hash), permissions beyond it, issue before it, capture outside its half-open window, and capture at a time that the log doesn't cover or doesn't grant."""
    joined = _with_receipts(grants, receipts, permissions).join(states_at(grants.select("grant_id", "receipt_id", "captured_at"), log, marks, "captured_at", "grant_id"), "grant_id", "left")
    known = F.col("_r").isNotNull()
    same = {f"{c.removesuffix('_id')}_differs": ~known | F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("participant_id", "purpose_id", "study_id", "taxonomy")}
    inside = (F.col("captured_at") >= F.col("_granted_at")) & (F.col("_valid_until").isNull() | (F.col("captured_at") < F.col("_valid_until")))
    rules = {"receipt_missing": known, **same, "scope_hash_differs": ~known | F.col("receipt_scope_sha256").eqNullSafe(F.col("_hash")), "issued_early": ~known | (F.col("issued_at") >= F.col("_granted_at"))}
    rules |= {f"{p}_widened": ~known | ~F.col(p) | F.col(f"_{p}") for p in permissions}
    rules |= {"captured_outside": ~known | inside, "log_incomplete": ~known | (F.coalesce("state", F.lit("unknown")) != "unknown"), "captured_ungranted": ~known | F.coalesce("state", F.lit("unknown")).isin("granted", "unknown")}
    return violations(joined, rules, "grant_id")


def authorizations(requests: DataFrame, grants: DataFrame, receipts: DataFrame, log: DataFrame, marks: DataFrame, permissions: tuple[str, ...], future: str = "future_research") -> DataFrame:
    """(request_id, authorized, reason) for requests (request_id, grant_id, permission, at, purpose_id, study_id).

    Reasons, the first that holds: unknown_grant, log_incomplete, other_purpose, other_study (unless both scopes allow future research of the same
    purpose), before_capture, not_permitted, outside_window (half-open), not_granted (by the log as of the time), or granted. authorized is NULL where the log isn't complete.
    """
    joined = requests.join(_with_receipts(grants, receipts, permissions).withColumnsRenamed({"purpose_id": "_gp", "study_id": "_gs"}), "grant_id", "left")
    asked = joined.where("receipt_id IS NOT NULL").select("request_id", "receipt_id", "at")
    full = joined.join(states_at(asked, log, marks, "at", "request_id"), "request_id", "left")
    has = lambda prefix: F.coalesce(F.element_at(F.create_map(*[x for p in permissions for x in (F.lit(p), F.col(f"{prefix}{p}"))]), F.col("permission")), F.lit(False))
    later = F.coalesce(F.col(future) & F.col(f"_{future}"), F.lit(False))
    outside = (F.col("at") < F.col("_granted_at")) | F.coalesce(F.col("at") >= F.col("_valid_until"), F.lit(False))
    reason = (
        F.when(F.col("_r").isNull(), "unknown_grant").when(F.col("state") == "unknown", "log_incomplete").when(~F.col("purpose_id").eqNullSafe(F.col("_purpose_id")), "other_purpose")
        .when(~F.col("study_id").eqNullSafe(F.col("_study_id")) & ~later, "other_study").when(F.col("at") < F.col("captured_at"), "before_capture").when(~(has("") & has("_")), "not_permitted")
        .when(outside, "outside_window").when(F.col("state") != "granted", "not_granted").otherwise("granted")
    )
    return full.select("request_id", F.when(reason != "log_incomplete", reason == "granted").alias("authorized"), reason.alias("reason"))
