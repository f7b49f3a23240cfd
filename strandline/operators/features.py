"""Fixed-shape features of landmark sequences: resampling, normalization, differences, selection and masks, as one plan per recording."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .checks import violations
from .sequences import GapPolicy, Hand, Sequence, decided_gaps, timestamp_discontinuities

HANDS = ("hand_0", "hand_1")
#: Joints whose angle is taken (before, at, after), finger tips, and the palm's points.
ANGLES = ((0, 1, 2), (0, 5, 6), (0, 9, 10), (0, 13, 14), (0, 17, 18))
TIPS = (4, 8, 12, 16, 20)
PALM = (0, 5, 9, 17)


@dataclass(frozen=True)
class FeaturePlan:
    """What features a frame has and the shape of a sequence. representation: hand_local, body_relative or combined; differences are of positions only."""

    representation: str = "combined"
    points: int = 21
    angles: bool = False
    tips: bool = False
    differences: int = 0
    frames: int = 64
    rate: int = 30

    @property
    def local(self) -> bool:
        return self.representation in ("hand_local", "combined")

    @property
    def body(self) -> bool:
        return self.representation in ("body_relative", "combined")

    @property
    def positions(self) -> int:
        return len(HANDS) * (3 * self.points * self.local + 4 * self.body)

    @property
    def width(self) -> int:
        return self.positions * (1 + self.differences) + len(HANDS) * (len(ANGLES) * self.angles + len(TIPS) * self.tips)


def _mix(left: Column, right: Column, share: Column) -> Column:
    """The signal at a share of the way; NULL where the hand isn't told as the same one at both ends."""
    between = lambda name, axes: F.zip_with(left[name], right[name], lambda a, b: F.struct(*((a[c] + (b[c] - a[c]) * share).alias(c) for c in axes))).alias(name)
    return F.when(left["left"].eqNullSafe(right["left"]), F.struct(between("world", "xyz"), between("image", "xy"), left["left"].alias("left")))


def _grid_after(t: Column, after: Column, first: Column, rate: int) -> Column:
    """Array of (t, before): the grid's times from a row's time (from 0 for a first row) until the next row's, and the grid's time before each. The last row (after is NULL) has the exact end too."""
    step = F.lit(1_000_000)
    nominal = lambda k: S.div(2 * k * step + rate, F.lit(2 * rate))
    low, high, last = F.when(first, F.lit(0)).otherwise(t), F.coalesce(after, t + 1), S.div(F.coalesce(after, t) * rate, step)
    item = lambda x, before: F.struct(x.alias("t"), before.alias("before"))
    begin = F.when(first, F.lit(0)).otherwise(S.div(t * rate, step)).cast("bigint")
    each = F.filter(F.transform(F.sequence(begin, last), lambda k: item(nominal(k), F.when(k > 0, nominal(k - 1)))), lambda x: (x["t"] >= low) & (x["t"] < high))
    end = item(t, F.when(nominal(last) < t, nominal(last)).otherwise(nominal(last - 1)))
    return F.when(after.isNull() & (nominal(last) != t), F.concat(each, F.array(end))).otherwise(each)


def resample(frames: DataFrame, policy: GapPolicy, rate: int = 30, seq: Sequence = Sequence(), hands: dict[str, Hand] | None = None) -> DataFrame:
    """(rec, t, hand_0, hand_1, body, evidence and cut of each) on the elapsed-time grid. cut: a preserved gap of the signal meets the stretch from the grid's time before.

    With hands, gaps whose ends may be different hands, or aren't told confidently, are preserved too.

    A signal is the sample at that very time (observed), or lies between two adjacent samples or inside an approved gap
    (interpolated), or is NULL. A signal is a struct of world points (x, y, z), image points (x, y) and whether the hand was told as
    a left one; of the body, the image points are the left and right shoulder and the rest is NULL. Times of a recording must rise.

    Gaps are decided on rows without points; their decisions go as marks among the frames, which are shuffled once, by recording. Each frame then knows the
    samples around it and gives the grid's times up to the next frame.
    """
    signals = (*HANDS, "body")
    flag = lambda s: F.col(f"_{s}")
    parts = {h: {"present": x.present, "label": x.label, "confidence": x.confidence} | {f"wrist{k}": c for k, c in enumerate(x.wrist)} | {f"palm{k}": c for k, c in enumerate(x.palm)} for h, x in (hands or {}).items()}
    told = [c for c in ("jump", "in_swap") if c in frames.columns]
    slim = frames.select("rec", "i", "t", "invalid", *told, *(F.col(s).isNotNull().alias(f"_{s}") for s in signals), *(c.alias(f"_{h}_{n}") for h, x in parts.items() for n, c in x.items()))
    column = lambda h, n: F.col(f"_{h}_{n}")
    slim_hands = {h: Hand(*(column(h, n) for n in ("present", "label", "confidence")), *(tuple(column(h, f"{n}{k}") for k in range(len(c))) for n, c in (("wrist", x.wrist), ("palm", x.palm)))) for h, x in (hands or {}).items()}
    gaps = decided_gaps(slim, {s: flag(s) for s in signals}, policy, F.col("invalid"), slim_hands or None, seq)
    marks = gaps.groupBy("rec", F.col("first_index").alias("i")).agg(*(F.bool_or(F.when(F.col("signal") == s, F.col("decision") == "interpolate_linear")).alias(f"_fill_{s}") for s in signals))
    rows = frames.select("rec", "i", "t", F.lit(True).alias("_frame"), *(F.col(s).isNotNull().alias(f"_{s}") for s in signals), *(F.col(s)["left"].alias(f"_left_{s}") for s in signals), *signals)
    rows = rows.unionByName(marks.withColumn("_frame", F.lit(False)), allowMissingColumns=True)
    back = Window.partitionBy("rec").orderBy("i", "_frame").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy("rec").orderBy(F.desc("i"), F.desc("_frame")).rowsBetween(Window.unboundedPreceding, -1)
    near = lambda c, w: F.last(c, ignorenulls=True).over(w)
    sample = lambda s: F.when(flag(s), F.struct("i", "t", F.col(f"_left_{s}").alias("left")))
    after = F.when(F.col("_frame"), F.struct("t", *(flag(s).alias(s) for s in signals)))
    rows = rows.select("*", near(after, ahead).alias("_after"), *(near(sample(s), ahead).alias(f"_r_{s}") for s in signals), *(near(F.col(s), ahead).alias(f"_rv_{s}") for s in signals), *(near(F.col(f"_fill_{s}"), ahead).alias(f"_next_{s}") for s in signals))
    rows = rows.select("*", near(F.when(F.col("_frame"), F.col("i")), back.rowsBetween(Window.unboundedPreceding, -1)).isNull().alias("_first"), *(near(sample(s), back).alias(f"_l_{s}") for s in signals), *(near(F.col(s), back).alias(f"_lv_{s}") for s in signals), *(near(F.col(f"_fill_{s}"), back).alias(f"_own_{s}") for s in signals))
    kept = lambda s: ~flag(s) & ~F.col(f"_own_{s}")
    rows = rows.select("*", *(near(F.when(kept(s), F.col("t")), back).alias(f"_kept_{s}") for s in signals)).where("_frame")
    absent_next = lambda s: F.coalesce(~F.col("_after")[s], F.lit(False))
    bridged = lambda s: F.when(flag(s), absent_next(s) & F.col(f"_next_{s}")).otherwise(F.col(f"_own_{s}"))
    found = []
    for s in signals:
        l, r = F.col(f"_l_{s}"), F.col(f"_r_{s}")
        between = r.isNotNull() & l["left"].eqNullSafe(r["left"]) & ((r["i"] - l["i"] == 1) | bridged(s))
        found += [F.coalesce(between, F.lit(False)).alias(f"_between_{s}"), (kept(s) & absent_next(s)).alias(f"_inside_{s}")]
    grid = rows.select("*", *found, F.explode(_grid_after(F.col("t"), F.col("_after.t"), F.col("_first"), rate)).alias("_x"))
    t = F.col("_x.t")

    def columns(s: str) -> list[Column]:
        l, r = F.col(f"_l_{s}"), F.col(f"_r_{s}")
        exact = l["t"] == t
        between = l.isNotNull() & (l["t"] <= t) & F.col(f"_between_{s}")
        value = F.when(exact, F.col(f"_lv_{s}")).when(between, _mix(F.col(f"_lv_{s}"), F.col(f"_rv_{s}"), (t - l["t"]) / (r["t"] - l["t"])))
        cut = F.col("_x.before").isNotNull() & (t >= F.col("t")) & (F.coalesce(F.col(f"_kept_{s}") >= F.col("_x.before"), F.lit(False)) | F.col(f"_inside_{s}"))
        return [value.alias(s), F.when(exact, "observed").when(between, "interpolated").alias(f"{s}_evidence"), cut.alias(f"{s}_cut")]

    return grid.select("rec", t.alias("t"), *(c for s in signals for c in columns(s)))


def frame_features(grid: DataFrame, plan: FeaturePlan, mirrored: Column) -> DataFrame:
    """(rec, t, v, o, presence of the hands, body_available). v: an array of values, NULL where a feature can't be had; o: whether each, if it can, is observed and not interpolated.

    World points are made hand-local; wrist and palm of the image are given relative to the shoulders. A hand without scale or a frame
    without shoulders only lacks its own features. Differences of the positions come last, order by order; they stop at a signal's cuts, those
    relative to the body also at the body's. Evidence and cuts are those of a whole signal, so they are kept for each signal and not for each value.
    """
    for h in HANDS:
        grid = grid.withColumn(f"_{h}", S.hand_local(F.col(h)["world"], F.col(h)["left"], mirrored)).withColumn(f"_i{h}", S.unmirror(F.col(h)["image"], mirrored))
    body = S.unmirror(F.col("body")["image"], mirrored)
    grid = grid.withColumn("_body", body).withColumn("_l", F.get("_body", F.lit(0))).withColumn("_r", F.get("_body", F.lit(1)))
    relative = lambda x, y: S.body_relative(x, y, F.col("_l.x"), F.col("_l.y"), F.col("_r.x"), F.col("_r.y"))
    sure = lambda *signals: F.coalesce(F.expr(" AND ".join(f"{x}_evidence = 'observed'" for x in signals)), F.lit(False))

    def local(h: str) -> Column:
        # the points by a lambda, so that the expression doesn't grow with them
        at = lambda k: F.get(f"_{h}", k)
        return F.when(F.col(f"_{h}").isNotNull(), F.flatten(F.transform(F.sequence(F.lit(0), F.lit(plan.points - 1)), lambda k: F.array(*(at(k)[c] for c in "xyz")))))

    def seen(h: str) -> Column:
        rel = [relative(p["x"], p["y"]) for p in (F.get(f"_i{h}", F.lit(0)), S.centroid(F.col(f"_i{h}"), PALM))]
        return F.array(*(p[c] for p in rel for c in "xy"))

    # values of a signal that go together: their number, whether they are observed, and where their differences stop
    groups: dict[str, tuple[int, Column, Column]] = {}
    values: dict[str, Column] = {}
    for h in HANDS if plan.local else ():
        groups[h], values[h] = (3 * plan.points, sure(h), F.col(f"{h}_cut")), local(h)
    for h in HANDS if plan.body else ():
        groups[f"{h}_body"], values[f"{h}_body"] = (4, sure(h, "body"), F.col(f"{h}_cut") | F.col("body_cut")), seen(h)
    more: list[tuple[int, Column, Column]] = []
    for h in HANDS if plan.angles else ():
        at = lambda k, h=h: F.get(f"_{h}", F.lit(k))
        more.append((len(ANGLES), sure(h), F.array(*(S.angle(at(a), at(b), at(c)) for a, b, c in ANGLES))))
    for h in HANDS if plan.tips else ():
        more.append((len(TIPS), sure(h), S.tip_distances(F.col(f"_{h}"), TIPS)))
    several = lambda arrays: F.concat(*arrays) if len(arrays) else F.array().cast("array<double>")
    keep = ("rec", "t", *(F.col(h).isNotNull().alias(f"{h}_present") for h in HANDS), relative(F.lit(0.0), F.lit(0.0)).isNotNull().alias("body_available"))
    made = grid.select(
        *keep, several([v for _, _, v in more]).alias("_more"), F.flatten(F.array(*(F.array_repeat(o, n) for n, o, _ in more))).alias("_more_o") if more else F.array().cast("array<boolean>").alias("_more_o"),
        *(values[g].alias(f"_v0_{g}") for g in groups), *(o.alias(f"_o0_{g}") for g, (_, o, _) in groups.items()), *(cut.alias(f"_cut_{g}") for g, (_, _, cut) in groups.items()),
    )
    w = Window.partitionBy("rec").orderBy("t")
    made = made.withColumn("_s", (F.col("t") - F.lag("t").over(w)) / 1e6)
    for k in range(plan.differences):
        made = made.select("*", *(F.lag(f"_{x}{k}_{g}").over(w).alias(f"_last_{x}_{g}") for x in "vo" for g in groups))
        step = lambda g: F.when((F.col("_s") > 0) & ~F.col(f"_cut_{g}"), F.zip_with(f"_v{k}_{g}", f"_last_v_{g}", lambda a, b: (a - b) / F.col("_s")))  # noqa: B023, E731
        made = made.select("*", *(step(g).alias(f"_v{k + 1}_{g}") for g in groups), *((F.col(f"_o{k}_{g}") & F.col(f"_last_o_{g}")).alias(f"_o{k + 1}_{g}") for g in groups)).drop(*(f"_last_{x}_{g}" for x in "vo" for g in groups))
    whole = lambda k, g: F.coalesce(F.col(f"_v{k}_{g}"), F.array_repeat(F.lit(None).cast("double"), groups[g][0]))
    told = lambda k, g: F.array_repeat(F.coalesce(F.col(f"_o{k}_{g}"), F.lit(False)), groups[g][0])
    ordered = lambda x, of: F.concat(*(of(0, g) for g in groups), F.col(x), *(of(k + 1, g) for k in range(plan.differences) for g in groups))
    return made.select("rec", "t", ordered("_more", whole).alias("v"), ordered("_more_o", told).alias("o"), *(f"{h}_present" for h in HANDS), "body_available")


def derive_features(frames: DataFrame, policy: GapPolicy, plan: FeaturePlan = FeaturePlan(), mirrored: Column | None = None, hands: dict[str, Hand] | None = None) -> DataFrame:
    """One row per recording: status (derived or refused) and reason, timestamps_us, values_q (frames x features, millionths), valid, observed and interpolated masks, hand_present, body_available and padding masks, source_grid_frame_count.

    Recordings with a timestamp discontinuity are refused: their row has that reason and nothing else. frames: rec, i, t, invalid, and the signals hand_0, hand_1 and
    body as `resample` takes them; mirrored: whether the camera of a recording (rec) was mirrored; hands: see resample. Only the picked frames of a recording are brought together.
    """
    bad = timestamp_discontinuities(frames.select("rec", "i", "t"), policy).select("rec").distinct()
    good = frames.join(bad, "rec", "left_anti")
    grid = resample(good, policy, plan.rate, hands=hands)
    made = frame_features(grid, plan, mirrored if mirrored is not None else F.lit(False))
    every = Window.partitionBy("rec")
    placed = made.withColumn("_k", (F.row_number().over(every.orderBy("t")) - 1).cast("bigint")).withColumn("_n", F.count("*").over(every))
    picked = placed.where(F.array_contains(S.uniform_indices(F.col("_n"), plan.frames), F.col("_k")))
    seq = picked.groupBy("rec").agg(F.max("_n").alias("source_grid_frame_count"), F.sort_array(F.collect_list(F.struct("t", "v", "o", F.array(*(f"{h}_present" for h in HANDS)).alias("hands"), "body_available"))).alias("s"))
    per = lambda fn: F.transform("s", fn)
    zero = lambda v: F.array_repeat(v, plan.width)
    last = F.element_at("s", -1)["t"]
    late = F.transform(F.sequence(F.lit(1), F.lit(plan.frames)), lambda k: last + S.div(k.cast("bigint") * 2_000_000 + plan.rate, F.lit(2 * plan.rate)))
    times = F.transform("s", lambda x: x["t"])
    false = F.lit(False)
    derived = seq.select(
        "rec", F.lit("derived").alias("status"), F.lit(None).cast("string").alias("reason"), "source_grid_frame_count", F.slice(F.concat(times, late), 1, plan.frames).alias("timestamps_us"),
        S.pad(per(lambda x: F.transform(x["v"], lambda v: F.coalesce(S.quantize(v), F.lit(0).cast("bigint")))), plan.frames, zero(F.lit(0).cast("bigint"))).alias("values_q"),
        S.pad(per(lambda x: F.transform(x["v"], lambda v: v.isNotNull())), plan.frames, zero(false)).alias("valid_mask"),
        S.pad(per(lambda x: F.zip_with(x["v"], x["o"], lambda v, o: v.isNotNull() & o)), plan.frames, zero(false)).alias("observed_mask"), S.pad(per(lambda x: F.zip_with(x["v"], x["o"], lambda v, o: v.isNotNull() & ~o)), plan.frames, zero(false)).alias("interpolated_mask"),
        S.pad(F.transform("s", lambda x: x["hands"]), plan.frames, F.array(false, false)).alias("hand_present_mask"), S.pad(F.transform("s", lambda x: x["body_available"]), plan.frames, false).alias("body_available_mask"),
        F.transform(F.sequence(F.lit(1), F.lit(plan.frames)), lambda k: k > F.size("s")).alias("padding_mask"),
    )
    return derived.unionByName(bad.select("rec", F.lit("refused").alias("status"), F.lit("timestamp_discontinuity").alias("reason")), allowMissingColumns=True)


def feature_violations(features: DataFrame, plan: FeaturePlan, key: str = "rec") -> DataFrame:
    """(rule_id, key): wrong shapes, masks that aren't exclusive, stored values where masked, padding that isn't a suffix, times that don't rise. Refused recordings have nothing to check."""
    features = features.where("status = 'derived'") if "status" in features.columns else features
    both = F.zip_with("observed_mask", "interpolated_mask", lambda a, b: F.zip_with(a, b, lambda x, y: ~(x & y)))
    sums = F.zip_with(F.zip_with("observed_mask", "interpolated_mask", lambda a, b: F.zip_with(a, b, lambda x, y: x | y)), "valid_mask", lambda a, b: F.zip_with(a, b, lambda x, y: x == y))
    neutral = F.zip_with("values_q", "valid_mask", lambda a, b: F.zip_with(a, b, lambda x, y: y | (x == 0)))
    all_ = lambda c: F.forall(c, lambda r: F.forall(r, lambda x: x))
    shape = (F.size("values_q") == plan.frames) & F.forall("values_q", lambda r: F.size(r) == plan.width)
    first_pad = F.array_position("padding_mask", True)
    rules = {
        "shape": shape, "masks_overlap": all_(both), "valid_differs": all_(sums), "masked_value": all_(neutral),
        "padding_not_suffix": (first_pad == 0) | F.forall(F.slice("padding_mask", F.greatest(first_pad, F.lit(1)), F.size("padding_mask")), lambda x: x),
        "times_not_rising": F.forall(F.zip_with(F.slice("timestamps_us", 1, plan.frames - 1), F.slice("timestamps_us", 2, plan.frames - 1), lambda a, b: a < b), lambda x: x),
    }
    return violations(features, rules, key)


def training_violations(features: DataFrame, split: DataFrame, key: str = "rec", partition: str = "train") -> DataFrame:
    """(rule_id, key): fit inputs from outside the partition, without assignment, more than once, or of another width."""
    s = split.select(F.col(key).alias("_k"), F.col("partition").alias("_p"))
    n = features.groupBy(F.col(key).alias("_d")).agg(F.count("*").alias("_n"))
    width = F.size(F.get("values_q", F.lit(0)))
    joined = features.select(key, width.alias("_w")).join(s, F.col(key) == F.col("_k"), "left").join(n, F.col(key) == F.col("_d"))
    usual = features.agg(F.mode(width).alias("_usual"))
    joined = joined.crossJoin(F.broadcast(usual))
    return violations(joined, {"unassigned": F.col("_p").isNotNull(), "other_partition": F.col("_p").isNull() | (F.col("_p") == partition), "repeated": F.col("_n") == 1, "width_differs": F.col("_w") == F.col("_usual")}, key)


def transition_fragments(sequences: DataFrame, pairs: DataFrame, key: str, values: str, padded: str, frames: int, neutral: Column) -> DataFrame:
    """(first, other, values, label): the second half of one sequence and the first half of another, without their padding, padded anew."""
    kept = lambda v, p: F.filter(F.zip_with(v, p, lambda a, b: F.when(~b, a)), lambda x: x.isNotNull())
    own = sequences.select(F.col(key).alias("_k"), kept(values, padded).alias("_v"))
    a = own.select(F.col("_k").alias("_a"), F.col("_v").alias("_va"))
    b = own.select(F.col("_k").alias("_b"), F.col("_v").alias("_vb"))
    joined = pairs.join(a, F.col("first") == F.col("_a")).join(b, F.col("other") == F.col("_b"))
    half = lambda c: S.div(F.size(c), F.lit(2)).cast("int")
    both = F.concat(F.slice("_va", half("_va") + 1, F.size("_va")), F.slice("_vb", 1, half("_vb")))
    return joined.select("first", "other", S.pad(F.slice(both, 1, frames), frames, neutral).alias(values), F.lit("other").alias("label"))
