"""Quality of frame sequences: counts, metrics, threshold findings, dispositions and the checks of reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import div, ratio_ppm
from .checks import violations
from .sequences import GapPolicy, Hand, Sequence, decided_gaps, with_jumps, with_speed, with_swaps

SEVERITIES = ("warning", "quarantine", "reject")


def _hands(signals: dict[str, Column]) -> Column:
    return sum((F.coalesce(p, F.lit(False)).cast("int") for p in signals.values()), F.lit(0))


def observation_counts(frames: DataFrame, signals: dict[str, Column], invalid: str = "invalid", seq: Sequence = Sequence()) -> DataFrame:
    """Per entity: frames, valid, invalid, frames by number of signals present, and presence of each."""
    hands = _hands(signals)
    return frames.groupBy(seq.entity).agg(
        F.count("*").alias("frames"), F.count_if(~F.col(invalid)).alias("valid"), F.count_if(F.col(invalid)).alias("invalid"),
        *(F.count_if(hands == k).alias(f"with_{k}") for k in range(len(signals) + 1)), *(F.count_if(p).alias(f"seen_{s}") for s, p in signals.items()),
    )


def quality_metrics(
    frames: DataFrame, signals: dict[str, Column], policy: GapPolicy, expected: Column, invalid: str = "invalid", seq: Sequence = Sequence(), hands: dict[str, Hand] | None = None,
    reasons: dict[str, Column] | None = None, anchors: dict[str, tuple[Column, Column]] | None = None, least_score_ppm: int = 500_000, motion: tuple[dict[str, tuple[Column, tuple[Column, ...]]], float] | None = None,
) -> DataFrame:
    """One row per entity of integer counts and ppm: coverage is the sum of min(present, expected) over frames * expected.

    With hands: scores of handedness, low ones and their share (NULL without scores), and suspected swaps. With reasons: invalid frames of each.
    With anchors (presence and score in millionths): presence and coverage of each as arrays in their order, the least coverage, scores and low
    ones. With motion (slots and limit): rows that moved faster. All of it is windows over one partitioning by entity and one aggregate; gaps join it.
    """
    total = lambda parts: sum(parts, F.lit(0).cast("bigint"))
    wanted = with_jumps(frames.withColumn("_expected", expected), policy, seq)
    more, shown = [F.count_if(c).alias(f"invalid_{k}") for k, c in (reasons or {}).items()], [f"invalid_{k}" for k in reasons or {}]
    if hands:
        wanted = with_swaps(wanted, tuple(hands.values()), policy, seq)
        scored = [h.present & h.label.isNotNull() & h.confidence.isNotNull() for h in hands.values()]
        more += [total(F.count_if(c) for c in scored).alias("hand_scores"), F.count("swap_from").alias("swaps")]
        more += [total(F.count_if(c & (h.confidence < policy.least_confidence_ppm)) for c, h in zip(scored, hands.values(), strict=True)).alias("low_hand_scores")]
        shown += ["hand_scores", "low_hand_scores", F.when(F.col("hand_scores") > 0, ratio_ppm("low_hand_scores", "hand_scores")).alias("low_hand_ppm"), "swaps"]
    if anchors:
        more += [F.array(*(F.count_if(p) for p, _ in anchors.values())).alias("pose_seen"), total(F.count_if(p & s.isNotNull()) for p, s in anchors.values()).alias("pose_scores")]
        more += [total(F.count_if(p & (s < least_score_ppm)) for p, s in anchors.values()).alias("low_pose_scores")]
        cover = F.transform("pose_seen", lambda n: ratio_ppm(n, F.col("frames")))
        shown += ["pose_seen", cover.alias("pose_ppm"), F.array_min(cover).alias("least_pose_ppm"), "pose_scores", "low_pose_scores"]
    if motion:
        wanted = with_speed(wanted, motion[0], seq)
        more.append(F.count_if(F.col("speed") > motion[1]).alias("motion_jumps"))
        shown.append("motion_jumps")
    base = wanted.groupBy(seq.entity).agg(
        F.count("*").alias("frames"), F.count_if(F.col(invalid)).alias("_bad"), F.sum(F.least(_hands(signals), F.col("_expected"))).cast("bigint").alias("expected_seen"),
        F.count_if(_hands(signals) > 0).alias("any_hand"), F.max("_expected").cast("bigint").alias("expected"), F.count_if("jump").alias("jumps"),
        F.count("step").alias("steps"), F.max("median_step").alias("median_step"), F.max("step").alias("longest_step"), *more,
    )
    decided = decided_gaps(wanted, signals, policy, F.col(invalid), hands, seq)
    filled = F.col("decision") == "interpolate_linear"
    open_ = ~filled & (F.col("boundary") == "internal")
    by_gap = decided.groupBy(seq.entity).agg(F.count("*").alias("gaps"), F.count_if(filled).alias("filled_gaps"), F.max(F.when(open_, F.col("missing"))).alias("longest_open"), F.max(F.when(open_, F.col("duration"))).alias("longest_open_us"))
    joined = base.join(by_gap, seq.entity, "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("bigint")).alias(c)
    return joined.select(
        seq.entity, "frames", (F.col("frames") - F.col("_bad")).alias("valid"), ratio_ppm("_bad", "frames").alias("invalid_ppm"), "expected", "expected_seen",
        (F.col("frames") * F.col("expected")).alias("expected_places"), ratio_ppm("expected_seen", F.col("frames") * F.col("expected")).alias("coverage_ppm"),
        "any_hand", *(zero(c) for c in ("gaps", "filled_gaps", "longest_open", "longest_open_us")), "jumps", "steps", "median_step", "longest_step", *shown,
    )


def apply_thresholds(metrics: DataFrame, rules: list[tuple[str, bool, int, int, int]], entity: str = "rec") -> DataFrame:
    """(entity, metric, value, severity): the highest violated severity of each rule (metric, higher is worse, warning, quarantine, reject).

    Limits are strict and may be None; a NULL metric is skipped.
    """
    def severity(metric: str, higher: bool, *limits: int | None) -> Column:
        out = F.lit(None).cast("string")
        for name, limit in zip(SEVERITIES, limits, strict=True):  # the last one that holds wins
            if limit is not None:
                out = F.when(F.col(metric) > limit if higher else F.col(metric) < limit, name).otherwise(out)
        return F.struct(F.lit(metric).alias("metric"), F.col(metric).cast("bigint").alias("value"), out.alias("severity"))

    found = metrics.select(entity, F.explode(F.array(*(severity(*r) for r in rules))).alias("f")).select(entity, "f.*")
    return found.where("severity IS NOT NULL")


def disposition(metrics: DataFrame, findings: DataFrame, entity: str = "rec") -> DataFrame:
    """Per entity the worst severity, `pass` without findings; no valid frame or nothing detected at all is a reject."""
    rank = sum((F.when(F.col("severity") == s, k + 1).otherwise(0) for k, s in enumerate(SEVERITIES)), F.lit(0))
    worst = findings.groupBy(entity).agg(F.max(rank).alias("_worst"), F.count("*").alias("findings"))
    named = F.element_at(F.array(F.lit("pass"), *map(F.lit, SEVERITIES)), F.coalesce("_worst", F.lit(0)) + 1)
    joined = metrics.select(entity, "valid", "any_hand").join(worst, entity, "left")
    return joined.select(entity, F.when((F.col("valid") == 0) | (F.col("any_hand") == 0), "reject").otherwise(named).alias("disposition"), F.coalesce("findings", F.lit(0).cast("bigint")).alias("findings"))


def with_disposition(metrics: DataFrame, rules: list[tuple[str, bool, int, int, int]]) -> DataFrame:
    """Adds disposition and the number of findings to each metrics row, as apply_thresholds and disposition give them, without another pass over the metrics."""

    def rank(metric: str, higher: bool, *limits: int | None) -> Column:
        out = F.lit(0)
        for k, limit in enumerate(limits, 1):
            if limit is not None:
                out = F.when(F.col(metric) > limit if higher else F.col(metric) < limit, k).otherwise(out)
        return out

    ranks = F.array(*(rank(*r) for r in rules))
    named = F.element_at(F.array(F.lit("pass"), *map(F.lit, SEVERITIES)), F.col("_worst") + 1)
    rated = metrics.withColumn("_worst", F.array_max(ranks)).withColumn("findings", F.size(F.filter(ranks, lambda x: x > 0)).cast("bigint"))
    return rated.withColumn("disposition", F.when((F.col("valid") == 0) | (F.col("any_hand") == 0), "reject").otherwise(named)).drop("_worst")


def dataset_quality(reports: DataFrame) -> DataFrame:
    """One row over all reports: sums, extremes, weighted ppm and whether the data are ready."""
    n = lambda d: F.count_if(F.col("disposition") == d)
    blocked = F.count_if(F.col("disposition").isin("quarantine", "reject")) > 0
    return reports.agg(
        F.count("*").alias("recordings"), F.sum("frames").alias("frames"), ratio_ppm(F.sum(F.col("frames") - F.col("valid")), F.sum("frames")).alias("invalid_ppm"), F.min("coverage_ppm").alias("least_coverage"), F.max("longest_open").alias("longest_open"), F.sum("jumps").alias("jumps"),
        n("pass").alias("passed"), n("warning").alias("warned"), n("quarantine").alias("quarantined"), n("reject").alias("rejected"),
        F.when(blocked, "blocked").when(n("warning") > 0, "ready_with_warnings").otherwise("ready").alias("status"),
    )


def report_violations(reports: DataFrame, findings: DataFrame, entity: str = "rec") -> DataFrame:
    """(rule_id, entity): stored values that don't follow from the stored counts and the findings derived anew."""
    derived = disposition(reports.drop("disposition", "findings"), findings, entity).select(F.col(entity).alias("_e"), F.col("disposition").alias("_d"))
    both = reports.join(derived, F.col(entity) == F.col("_e"), "left")
    rules = {
        "disposition_differs": F.col("disposition") == F.col("_d"), "valid_beyond_frames": F.col("valid") <= F.col("frames"), "filled_beyond_gaps": F.col("filled_gaps") <= F.col("gaps"),
        "invalid_ppm_differs": F.col("invalid_ppm") == ratio_ppm(F.col("frames") - F.col("valid"), F.col("frames")),
    }
    return violations(both, rules, entity)


def coverage_diagnostic(frames: DataFrame, present: Column, seq: Sequence = Sequence()) -> DataFrame:
    """Recordings by split and target (rolled up) and how many are covered beyond 50, 80 and 95 % between first and last detection."""
    every = Window.partitionBy(seq.entity)
    marked = frames.withColumn("_p", present)
    marked = marked.withColumn("_lo", F.min(F.when(F.col("_p"), F.col(seq.order))).over(every)).withColumn("_hi", F.max(F.when(F.col("_p"), F.col(seq.order))).over(every))
    each = marked.where(F.col(seq.order).between(F.col("_lo"), F.col("_hi"))).groupBy(seq.entity, "split", "target").agg(ratio_ppm(F.count_if("_p"), F.count("*")).alias("ppm"))
    return each.rollup("split", "target").agg(F.count("*").alias("recordings"), *(F.count_if(F.col("ppm") >= limit * 10_000).alias(f"over_{limit}") for limit in (50, 80, 95)))


def timeline_violations(frames: DataFrame, seq: Sequence = Sequence()) -> DataFrame:
    """(rule_id, entity, order): indexes that aren't 0..n-1, a start other than 0, times that don't rise strictly."""
    w = seq.window()
    marked = frames.withColumn("_k", F.row_number().over(w)).withColumn("_p", F.lag(seq.t).over(w))
    rules = {"time_not_rising": F.col("_p").isNull() | (F.col(seq.t) > F.col("_p")), "starts_not_at_zero": (F.col("_k") > 1) | (F.col(seq.t) == 0), "index_gap": F.col(seq.order) == F.col("_k") - 1}
    return violations(marked, rules, seq.entity, seq.order)


def frame_violations(frames: DataFrame, signals: dict[str, Column], count: str, invalid: str, seq: Sequence = Sequence()) -> DataFrame:
    """(rule_id, entity, order): a stored count that differs, an invalid frame that observes something."""
    rules = {"count_differs": F.col(count) == _hands(signals), "invalid_frame_observed": ~F.col(invalid) | (_hands(signals) == 0)}
    return violations(frames, rules, seq.entity, seq.order)


def palm_quantized(coordinates: list[Column]) -> Column:
    """A palm's coordinate in millionths: the mean of its points' coordinates, ties to even."""
    return F.bround(sum(coordinates[1:], coordinates[0]) * 1_000_000 / len(coordinates)).cast("bigint")


def project_observations(frames: DataFrame, slots: dict[str, tuple[Column, Column, Column]], invalid: str = "invalid", seq: Sequence = Sequence()) -> DataFrame:
    """Frames as observations (t, hand_present, quality_ok, motion_q) of the event detector.

    motion_q is the largest L1 displacement of a slot's palm since the last valid frame, in millionths a second, halves up, all in integers; a slot
    counts only if that frame had it too. slots: presence and the palm's x and y in millionths. Invalid frames move nothing and are skipped over.
    """
    parts = {f"{c}{k}": v for k, slot in enumerate(slots.values()) for c, v in zip("pxy", slot, strict=True)}
    now = F.when(~F.col(invalid), F.struct(F.col(seq.t).alias("t"), *(v.alias(c) for c, v in parts.items())))
    met = frames.withColumn("_now", now).withColumn("_old", F.last("_now", ignorenulls=True).over(seq.window().rowsBetween(Window.unboundedPreceding, -1)))
    elapsed = F.col("_now.t") - F.col("_old.t")
    speeds = [F.lit(0).cast("bigint")]
    for k in range(len(slots)):
        far = F.abs(F.col(f"_now.x{k}") - F.col(f"_old.x{k}")) + F.abs(F.col(f"_now.y{k}") - F.col(f"_old.y{k}"))
        speeds.append(F.when(F.col(f"_now.p{k}") & F.col(f"_old.p{k}") & (elapsed > 0), div(far * 1_000_000 + div(elapsed, F.lit(2)), elapsed)))
    any_hand = _hands({k: v[0] for k, v in slots.items()}) > 0
    valid = ~F.col(invalid)
    return met.select(seq.entity, seq.order, seq.t, (valid & any_hand).alias("hand_present"), valid.alias("quality_ok"), F.greatest(*speeds).alias("motion_q"))
