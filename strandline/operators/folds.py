"""Stratified folds of whole groups: chosen on the kinds of groups there are, dealt to the groups by Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .digests import multiset_digest


def fold_quotas(kinds: np.ndarray, groups: np.ndarray, folds: int) -> np.ndarray:
    """How many groups of each kind (a row of label counts) go to each fold, so that every fold has every label and labels are spread evenly.

    As many groups of a kind as divide by the folds are dealt equally, which changes no balance. What is left is assigned one by one:
    first, label by label from the rarest, to folds that lack it, by the kind that fills most gaps; then the most lopsided kinds first, each
    to the fold that leaves the least variance of label shares, then rows, then the lowest number. Raises ValueError if a fold still lacks a label.
    """
    labels = kinds.shape[1]
    holders = (kinds > 0).astype(np.int64).T @ groups
    if folds < 2 or (holders < folds).any():
        raise ValueError(f"{folds} folds need as many groups of each label; there are {holders.tolist()}")
    quota = np.repeat((groups // folds)[:, None], folds, axis=1)
    left = groups % folds
    counts = quota.T @ kinds
    total = np.maximum(groups @ kinds, 1)

    def give(kind: int, fold: int) -> None:
        quota[kind, fold] += 1
        left[kind] -= 1
        counts[fold] += kinds[kind]

    def move(label: int, fold: int) -> bool:
        """Takes a group with the label from a fold that keeps all its labels without it."""
        for other in np.argsort(-counts[:, label], kind="stable"):
            for kind in np.flatnonzero((quota[:, other] > 0) & (kinds[:, label] > 0)):
                if other != fold and ((counts[other] - kinds[kind] > 0) | (kinds[kind] == 0) | (counts[other] == 0)).all():
                    quota[kind, other] -= 1
                    quota[kind, fold] += 1
                    counts[other] -= kinds[kind]
                    counts[fold] += kinds[kind]
                    return True
        return False

    for label in np.argsort(holders, kind="stable"):
        for fold in range(folds):
            if counts[fold, label] == 0:
                able = np.flatnonzero((left > 0) & (kinds[:, label] > 0))
                if len(able):
                    fills = ((counts[fold] == 0) & (kinds[able] > 0)).sum(axis=1)
                    give(int(able[np.lexsort((kinds[able].sum(axis=1), -fills))[0]]), fold)
    for kind in np.argsort(-kinds.std(axis=1), kind="stable"):
        while left[kind]:
            after = np.repeat(counts[None], folds, axis=0)
            after[np.arange(folds), np.arange(folds)] += kinds[kind]
            spread = (after / total).std(axis=1).mean(axis=1)
            give(int(kind), int(np.lexsort((counts.sum(axis=1), np.round(spread, 12)))[0]))
    for label in range(labels):
        for fold in range(folds):
            if counts[fold, label] == 0 and not move(label, fold):
                raise ValueError(f"no assignment found that gives fold {fold} every label")
    return quota


def group_folds(df: DataFrame, group: str, label: str, folds: int, seed: int = 0, most_kinds: int = 100_000) -> DataFrame:
    """(group, fold): groups whole, every label in every fold and so outside of each, label shares as even as a greedy choice makes them.

    The driver sees one row per kind, which is a histogram of labels; more than most_kinds raise. The r-th group of a kind, by a hash of
    (seed, group), goes to the fold that its kind's quotas give to r. Ranks are counted within ranges of that hash, so a kind that holds
    most groups is dealt to many tasks. A null label is a label of its own, and null ids are one group. Fewer groups of a label than folds raise ValueError.
    """
    counted = df.groupBy(group, label).agg(F.count("*").alias("_n"))
    hist = counted.groupBy(group).agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("l"), F.col("_n").alias("n")))).alias("_h"))
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.coalesce(F.col(group).cast("string"), F.lit("null"))).cast("binary"))
    kinds = hist.withColumn("_kind", F.sha2(F.to_json("_h", {"ignoreNullFields": "false"}), 256)).withColumn("_o", order).withColumn("_part", F.substring("_o", 1, 2))
    parts = kinds.groupBy("_kind", "_part").agg(F.count("*").alias("_m"), F.first("_h").alias("_h"))
    found = parts.groupBy("_kind").agg(F.sum("_m").alias("m"), F.first("_h").alias("h")).orderBy("_kind").limit(most_kinds + 1).collect()
    if len(found) > most_kinds:
        raise ValueError(f"more than {most_kinds} kinds of groups")
    if not found:
        return hist.select(group, F.lit(None).cast("int").alias("fold"))
    names: dict = {}
    for r in found:
        for x in r["h"]:
            names.setdefault(x["l"], len(names))
    table = np.zeros((len(found), len(names)), np.int64)
    for k, r in enumerate(found):
        for x in r["h"]:
            table[k, names[x["l"]]] = x["n"]
    quota = fold_quotas(table, np.array([r["m"] for r in found], np.int64), folds)
    upto = df.sparkSession.createDataFrame([(r["_kind"], q.tolist()) for r, q in zip(found, np.cumsum(quota, axis=1), strict=True)], "_kind string, _upto array<bigint>")
    before = F.coalesce(F.sum("_m").over(Window.partitionBy("_kind").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("_kind", "_part", before.alias("_start"))
    place = F.row_number().over(Window.partitionBy("_kind", "_part").orderBy("_o", group)) - 1
    dealt = kinds.select(group, "_kind", "_part", place.alias("_p")).join(starts, ["_kind", "_part"]).join(F.broadcast(upto), "_kind")
    return dealt.select(group, F.size(F.filter("_upto", lambda x: x <= F.col("_p") + F.col("_start"))).alias("fold"))


def fold_checks(df: DataFrame, assigned: DataFrame, group: str, label: str, folds: int) -> DataFrame:
    """(fold, label, groups, evaluated, fitted): for each fold and label the groups of the fold with it, and the rows on both sides. Groups in several folds or none raise no error here: they show in `groups`."""
    joined = df.groupBy(group, label).agg(F.count("*").alias("_n")).join(assigned, group)
    each = joined.groupBy("fold", label).agg(F.count("*").alias("groups"), F.sum("_n").alias("evaluated"))
    total = df.groupBy(label).agg(F.count("*").alias("_all"))
    return each.join(total, label).select("fold", label, "groups", "evaluated", (F.col("_all") - F.col("evaluated")).alias("fitted"))


def fold_digest(assigned: DataFrame, group: str, seed: int = 0) -> DataFrame:
    """(rows, digest) of an assignment, equal for equal ones however they are dealt."""
    item: Column = F.concat_ws(":", F.lit(str(seed)), F.col(group).cast("string"), F.col("fold").cast("string"))
    return multiset_digest(assigned, item)
