"""Lineage graphs, consent and withdrawal: joins and groups; graphs has closures and cycles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import opaque_id
from .checks import violations
from .graphs import closure


def edge_violations(nodes: DataFrame, edges: DataFrame, node: str, same: tuple[str, ...]) -> DataFrame:
    """(rule_id, parent, child): parents or children that don't exist, and columns that a child doesn't share with its parent."""
    names = (node, *same)
    p = nodes.select(*(F.col(c).alias(f"p_{c}") for c in names))
    c = nodes.select(*(F.col(x).alias(f"c_{x}") for x in names))
    joined = edges.join(p, F.col("parent") == F.col(f"p_{node}"), "left").join(c, F.col("child") == F.col(f"c_{node}"), "left")
    rules = {"parent_missing": F.col(f"p_{node}").isNotNull(), "child_missing": F.col(f"c_{node}").isNotNull()}
    known = F.col(f"p_{node}").isNotNull() & F.col(f"c_{node}").isNotNull()
    rules |= {f"{x}_differs": ~known | F.col(f"p_{x}").eqNullSafe(F.col(f"c_{x}")) for x in same}
    return violations(joined, rules, "parent", "child")


def metadata_violations(assets: DataFrame, edges: DataFrame, asset: str, ids: str, created: str) -> DataFrame:
    """(rule_id, asset): derived assets whose id set isn't the union of their parents', or that are older than one."""
    parents = edges.join(assets.select(F.col(asset).alias("_p"), F.col(ids).alias("_ids"), F.col(created).alias("_at")), F.col("parent") == F.col("_p"))
    union = parents.groupBy("child").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("_ids")))).alias("_union"), F.max("_at").alias("_newest"))
    joined = assets.join(union, F.col(asset) == F.col("child"))
    return violations(joined, {"ids_differ": F.array_sort(F.array_distinct(ids)) == F.col("_union"), "parent_newer": F.col("_newest") <= F.col(created)}, asset)


def scope_violations(scopes: DataFrame, key: str, implications: dict[str, tuple[str, str]], fixed: dict[str, bool]) -> DataFrame:
    """(rule_id, key): permissions without those they need (name: (a, b) for a implies b), flags that must have one value."""
    rules = {name: ~F.col(a) | F.col(b) for name, (a, b) in implications.items()} | {f"{c}_fixed": F.col(c) == v for c, v in fixed.items()}
    return violations(scopes, rules, key)


def grant_violations(grants: DataFrame, receipts: DataFrame, permissions: tuple[str, ...]) -> DataFrame:
    """(rule_id, grant_id): grants without receipt, for another participant, issued before it, or wider than it."""
    r = receipts.select(F.col("receipt_id").alias("_r"), F.col("participant_id").alias("_p"), F.col("granted_at").alias("_at"), *(F.col(p).alias(f"_{p}") for p in permissions))
    joined = grants.join(r, F.col("receipt_id") == F.col("_r"), "left")
    known = F.col("_r").isNotNull()
    rules = {"receipt_missing": known, "participant_differs": ~known | F.col("participant_id").eqNullSafe(F.col("_p")), "issued_early": ~known | (F.col("issued_at") >= F.col("_at"))}
    rules |= {f"{p}_widened": ~known | ~F.col(p) | F.col(f"_{p}") for p in permissions}
    return violations(joined, rules, "grant_id")


def authorized_at(grants: DataFrame, receipts: DataFrame, terminations: DataFrame, permission: str, at: Column) -> DataFrame:
    """(grant_id, authorized): the receipt's half-open window holds `at`, it isn't terminated by then, and both scopes have the permission."""
    ended = terminations.groupBy(F.col("receipt_id").alias("_e")).agg(F.min("terminated_at").alias("_end"))
    r = receipts.select(F.col("receipt_id").alias("_r"), "granted_at", "valid_until", F.col(permission).alias("_perm"))
    joined = grants.join(r, F.col("receipt_id") == F.col("_r"), "left").join(ended, F.col("receipt_id") == F.col("_e"), "left")
    ok = (at >= F.col("granted_at")) & (F.col("valid_until").isNull() | (at < F.col("valid_until"))) & (F.col("_end").isNull() | (at < F.col("_end"))) & F.col(permission) & F.col("_perm")
    return joined.select("grant_id", F.coalesce(ok, F.lit(False)).alias("authorized"))


def withdrawal_plan(requests: DataFrame, assets: DataFrame, edges: DataFrame, actions: dict[str, str]) -> DataFrame:
    """(request_id, asset_id, kind, reach, action, plan_id): every asset that a withdrawn participant's own assets lead to, for all requests at once."""
    direct = requests.join(assets.where("is_root"), "participant_id").select("request_id", F.col("asset_id").alias("root"))
    reach = closure(edges, direct.select("root").distinct())
    hit = direct.join(reach, "root").groupBy("request_id", F.col("node").alias("asset_id")).agg(F.min("depth").alias("_d"))
    named = F.create_map(*[F.lit(x) for kv in actions.items() for x in kv])
    joined = hit.join(assets.select("asset_id", "kind"), "asset_id")
    return joined.select("request_id", "asset_id", "kind", F.when(F.col("_d") == 0, "direct").otherwise("downstream").alias("reach"), F.coalesce(F.element_at(named, F.col("kind")), F.lit("review")).alias("action"), opaque_id("plan_", "withdrawal/1", F.col("request_id"), F.col("asset_id")).alias("plan_id"))


def quarantine(attempts: DataFrame, outcome: str, *order: str) -> DataFrame:
    """Attempts that weren't accepted, numbered within their first key."""
    return attempts.where(~F.col(outcome).eqNullSafe("accepted")).withColumn("place", F.row_number().over(Window.partitionBy(order[0]).orderBy(*order[1:])))


def raw_assets(recordings: DataFrame, recording: str, participant: str) -> DataFrame:
    """One root asset per recording."""
    return recordings.select(opaque_id("asset_", "raw-asset/1", F.col(recording)).alias("asset_id"), F.lit("raw_recording").alias("kind"), recording, participant)


def evaluate_gates(expected: DataFrame, evidence: DataFrame) -> DataFrame:
    """(gate, passed, reason) of expected (gate, digest) against evidence (gate, digest, ok): missing, stale or failed evidence doesn't pass."""
    e = evidence.select(F.col("gate").alias("_g"), F.col("digest").alias("_d"), "ok")
    joined = expected.join(e, F.col("gate") == F.col("_g"), "left")
    reason = F.when(F.col("_g").isNull(), "missing").when(~F.col("digest").eqNullSafe(F.col("_d")), "stale").when(~F.coalesce("ok", F.lit(False)), "failed").otherwise("passed")
    return joined.select("gate", (reason == "passed").alias("passed"), reason.alias("reason"))


def chain_links(child: DataFrame, parent: DataFrame, key: str, child_ref: tuple[str, ...], parent_id: tuple[str, ...]) -> DataFrame:
    """(key, status): references of several columns (kind, id, version, digest) that no parent has, or all columns but the last agree with."""
    full = parent.select(*(F.col(c).alias(f"_{k}") for k, c in enumerate(parent_id))).distinct()
    cond = F.lit(True)
    for k, c in enumerate(child_ref[:-1]):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_{k}"))
    last = len(child_ref) - 1
    found = child.join(full, cond, "left").groupBy(key, *child_ref).agg(F.count("_0").alias("_n"), F.bool_or(F.col(child_ref[-1]).eqNullSafe(F.col(f"_{last}"))).alias("_same"))
    return found.select(key, F.when(F.col("_n") == 0, "missing").when(F.col("_same"), "linked").otherwise("digest_differs").alias("status"))


def reconcile_counts(declared: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """(key, declared, actual) where the counts differ; a missing side is 0."""
    a = actual.select(F.col(key).alias("_k"), F.col("n").alias("_n"))
    both = declared.join(a, F.col(key).eqNullSafe(F.col("_k")), "full")
    zero = F.lit(0).cast("bigint")
    return both.select(F.coalesce(key, "_k").alias(key), F.coalesce("n", zero).alias("declared"), F.coalesce("_n", zero).alias("actual")).where("declared <> actual")
