"""The corpus job: from frames to a quota of recordings with their features, frozen under one digest."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .digests import multiset_digest, row_text
from .selection import select_quota
from .sequences import GapPolicy, Sequence, best_episode, episodes, slice_and_rebase


def select_corpus(frames: DataFrame, present: Column, policy: GapPolicy, judge: Callable[[DataFrame], DataFrame], quota: int, split: Column, signer: Column, accepted: tuple[str, ...] = ("pass", "warning"), motion: str | None = None, seq: Sequence = Sequence()) -> DataFrame:
    """(entity, split, signer, frames, disposition, place, and the window's first_index, last_index, first_t): each entity is cut to its best episode, the cut judged, and of what is accepted each split takes `quota` entities of distinct signers, by entity.

    judge: from cut frames to (entity, frames, disposition). split and signer are expressions of the entity. Entities without an episode or of another disposition aren't in it.
    """
    windows = best_episode(frames, episodes(frames, present, policy, motion, seq), seq=seq).where("status = 'selected'").select(seq.entity, "first_index", "last_index", "first_t")
    judged = judge(slice_and_rebase(frames, windows, seq)).where(F.col("disposition").isin(*accepted)).select(seq.entity, "frames", "disposition")
    chosen = select_quota(judged.withColumn("split", split).withColumn("signer", signer), quota, "signer", (seq.entity,), "split")
    return chosen.join(windows, seq.entity)


def corpus_features(chosen: DataFrame, landmarks: DataFrame, derive: Callable[[DataFrame], DataFrame], seq: Sequence = Sequence()) -> DataFrame:
    """The chosen entities with what derive makes of their windows' landmark frames, whose time begins at 0, and feature_digest, a hash of all of it. An entity that derive gives no row for has NULLs."""
    windows = chosen.select(seq.entity, "first_index", "last_index", F.lit(0).cast("bigint").alias("first_t"))
    # entities that aren't chosen go before their landmarks are sorted or shuffled
    cut = slice_and_rebase(landmarks.join(chosen.select(seq.entity), seq.entity, "left_semi"), windows, seq)
    made = derive(cut.withColumn(seq.t, F.col(seq.t) - F.min(seq.t).over(Window.partitionBy(seq.entity))))
    hashed = made.withColumn("feature_digest", F.sha2(row_text([c for c in made.columns if c != seq.entity]), 256))
    return chosen.drop("first_index", "last_index", "first_t").join(hashed, seq.entity, "left")


def frozen_digest(corpus: DataFrame, columns: tuple[str, ...] = ("rec", "split", "disposition", "place", "feature_digest"), *by: str) -> DataFrame:
    """(by, rows, digest) of a corpus: equal if and only if the same entities were chosen at the same places with the same features."""
    return multiset_digest(corpus, row_text(list(columns)), *by)
