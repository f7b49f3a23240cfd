"""The event detector: one transition function for a sequence's observations, used in batch and on streams alike.

inactive -> arming -> recording <-> finalizing -> cooldown -> inactive. Motion is smoothed on integers; an event begins at the
pre-roll before loud motion, ends with stillness, a gap in the signal, or the longest duration.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import stab, struct_fields

PPM = 1_000_000
EVENT_SCHEMA = "rec bigint, first_index bigint, last_index bigint, first_t bigint, last_t bigint, reason string"


@dataclass(frozen=True)
class Limits:
    """Motion in millionths a second, times in microseconds."""

    alpha_ppm: int = 500_000
    start_motion: int = 250_000
    stop_motion: int = 80_000
    most_motion: int = 12_000_000
    pre_roll: int = 100_000
    arming: int = 66_666
    least_event: int = 200_000
    most_event: int = 4_000_000
    finalization: int = 200_000
    gap_frames: int = 2
    gap_time: int = 100_000
    cooldown: int = 166_667


@dataclass
class State:
    """What a sequence's past means for its next observation; a few numbers and the pre-roll."""

    mode: str = "inactive"
    seen: int = 0
    t: int | None = None
    smooth: int | None = None
    roll: list = field(default_factory=list)
    armed: int | None = None
    start: list | None = None
    usable: list | None = None
    active: list | None = None
    quiet: int | None = None
    gap: int = 0
    calm: int | None = None

    def text(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def of(text: str | None) -> State:
        return State(**json.loads(text)) if text else State()

    def clear(self, mode: str, motion: bool) -> None:
        kept = self.smooth if not motion else None
        self.__dict__.update(asdict(State(mode=mode, seen=self.seen, t=self.t, smooth=kept)))


def _close(s: State, c: Limits, end: list, reason: str) -> tuple | None:
    """The event from its start to end, unless it is too short."""
    first = s.start
    return (first[0], end[0], first[1], end[1], reason) if end[1] - first[1] >= c.least_event else None


def step(s: State, c: Limits, t: int, hand: bool, ok: bool, motion: int) -> tuple | None:
    """Takes one observation into the state; gives an event if one ends. Raises ValueError unless time rises."""
    if s.t is not None and t <= s.t:
        raise ValueError("time must rise")
    here = [s.seen, t]
    s.seen, s.t = s.seen + 1, t
    usable = hand and ok and motion <= c.most_motion
    if usable:
        s.smooth = motion if s.smooth is None else (c.alpha_ppm * motion + (PPM - c.alpha_ppm) * s.smooth + PPM // 2) // PPM
    loud = s.smooth is not None and s.smooth >= c.start_motion
    still = s.smooth is not None and s.smooth <= c.stop_motion
    calm = ok and (not hand or (usable and still))

    if s.mode == "inactive":
        if usable and s.usable and t - s.usable[1] > c.gap_time:  # motion across a gap says nothing
            s.smooth, s.roll, s.usable = 0, [here], here
        elif usable:
            s.usable = here
            s.roll = [x for x in [*s.roll, here] if t - x[1] <= c.pre_roll]
            if loud:
                s.mode, s.start, s.armed, s.gap = "arming", s.roll[0], t, 0
        elif not hand:
            s.roll, s.usable, s.smooth = [], None, None
        return None

    if s.mode == "cooldown":
        s.calm = (s.calm if s.calm is not None else t) if calm else None
        if s.calm is not None and t - s.calm >= c.cooldown:
            s.clear("inactive", True)
        return None

    s.gap = s.gap if usable else s.gap + 1
    broken = s.gap > c.gap_frames or t - (s.usable or s.start)[1] > c.gap_time
    if s.mode == "arming":
        if broken or (usable and still):
            s.clear("inactive", True)
        elif usable:
            s.gap, s.usable = 0, here
            if t - s.armed >= c.arming:
                s.mode, s.active = "recording", here
        return None

    end, reason, deadline = None, "", s.start[1] + c.most_event
    if broken:
        end, reason = s.usable, "signal_gap"
    elif t > deadline:
        end, reason = s.usable, "max_duration"
    elif usable:
        s.gap, s.usable = 0, here
        if t == deadline:
            end, reason = here, "max_duration"
        elif s.mode == "recording":
            if still:
                s.mode, s.quiet = "finalizing", t
            else:
                s.active = here
        elif t - s.quiet >= c.finalization:
            end, reason = s.active, "settled"
        elif loud:
            s.mode, s.active, s.quiet = "recording", here, None
    if end is None:
        return None
    event = _close(s, c, end, reason)
    s.clear("cooldown", False)
    s.calm = t if calm else None
    return event


def finish(s: State, c: Limits) -> tuple | None:
    """The end of a sequence: a confirmed event closes, one still arming is dropped."""
    event = None
    if s.mode in ("recording", "finalizing"):
        end = s.active if s.mode == "finalizing" else s.usable
        event = _close(s, c, end, "stream_end") if end else None
    s.clear("inactive", True)
    return event


def run(rows: pd.DataFrame, state: State, limits: Limits) -> Iterator[tuple]:
    """Events of observations (t, hand_present, quality_ok, motion_q) in order of time; the state is carried on."""
    for t, hand, ok, motion in rows[["t", "hand_present", "quality_ok", "motion_q"]].itertuples(index=False):
        if (event := step(state, limits, int(t), bool(hand), bool(ok), int(motion))) is not None:
            yield event


def one_per_time(rows: pd.DataFrame) -> pd.DataFrame:
    """Rows in order of time; of several at one time the least of (hand_present, quality_ok, motion_q) stands, however they arrive."""
    return rows.sort_values(["t", "hand_present", "quality_ok", "motion_q"]).drop_duplicates("t")


def detect_events(observations: DataFrame, limits: Limits = Limits(), entity: str = "rec") -> DataFrame:
    """(rec, first_index, last_index, first_t, last_t, reason) of every sequence; a sequence fits one task, sequences are unlimited. Rows that repeat a time: see one_per_time."""

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        state, key = State(), int(rows[entity].iloc[0])
        found = list(run(one_per_time(rows), state, limits))
        last = finish(state, limits)
        return pd.DataFrame([(key, *e) for e in [*found, *([last] if last else [])]], columns=[x.split()[0] for x in EVENT_SCHEMA.split(", ")])

    return observations.select(F.col(entity).cast("bigint").alias("rec"), "t", "hand_present", "quality_ok", "motion_q").groupBy("rec").applyInPandas(whole, EVENT_SCHEMA)


def events_with_frames(events: DataFrame, frames: DataFrame, entity: str = "rec", t: str = "t", before: int = 0) -> DataFrame:
    """Frames of each event's span, `before` microseconds earlier on; a frame in several spans is given with each."""
    spans = events.select(F.col("rec").alias(entity), (F.col("first_t") - before).alias("_from"), "first_t", "last_t", "reason")
    met = stab(frames, spans, t, "_from", "last_t", (entity,))
    return met.select(*struct_fields("_p", frames.columns), *struct_fields("_v", ["first_t", "last_t", "reason"]))


@dataclass(frozen=True)
class Tracking:
    """Largest spatial cost of a continued identity, what a changed label costs, and how close costs are told apart no more."""

    most_cost: float = 0.25
    label_cost: float = 0.1
    margin: float = 0.02


class Slots:
    """The last detection of each of two slots: a place (coordinates of wrist and palm) and a label."""

    def __init__(self, rule: Tracking):
        self.rule, self.place, self.label = rule, [None, None], [None, None]

    def costs(self, places: np.ndarray, labels: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Slots x detections: the squared distance of all coordinates, and that with what a changed label costs; infinite for empty slots."""
        space = np.full((2, len(places)), np.inf)
        for s in (0, 1):
            if self.place[s] is not None:
                space[s] = ((places - self.place[s]) ** 2).sum(axis=1)
        changed = [[bool(a and b and a != b) for b in labels] for a in self.label]
        return space, space + self.rule.label_cost * np.array(changed, float).reshape(space.shape)

    def assign(self, places: np.ndarray, labels: list[str | None], order: list[int]) -> list[int]:
        """The slot of each of at most two detections: that of its identity where every nearly best assignment agrees, else by place.

        order ranks the detections by place, label and number. What no identity claims goes where the fewest identities are overwritten, then
        at the least cost, then in that order.
        """
        n = len(places)
        if not n:
            return []
        space, total = self.costs(places, labels)
        live = [s for s in (0, 1) if self.place[s] is not None]
        single = [(s, d) for s in live for d in range(n) if space[s, d] <= self.rule.most_cost]
        pairs = [(a, b) for a in single for b in single if a[0] < b[0] and a[1] != b[1]]
        ways = pairs or [(x,) for x in single] or [()]
        price = [sum(total[x] for x in w) for w in ways]
        agreed = set.intersection(*(set(w) for w, p in zip(ways, price, strict=True) if p <= min(price) + self.rule.margin))
        slots = {d: s for s, d in agreed}
        rest = sorted((d for d in range(n) if d not in slots), key=order.__getitem__)
        free = [s for s in (0, 1) if s not in slots.values()]
        if rest:
            fills = [list(zip(rest, w)) for w in ([(s,) for s in free] if len(rest) == 1 else [free, free[::-1]])]
            worth = lambda w: (sum(self.place[s] is not None for _, s in w), sum(total[s, d] for d, s in w if self.place[s] is not None), sorted((s, order[d]) for d, s in w))
            slots |= dict(min(fills, key=worth) if live else fills[0])
        for d, s in slots.items():
            self.place[s], self.label[s] = places[d], labels[d]
        return [slots[d] for d in range(n)]


def track_identities(detections: DataFrame, rule: Tracking = Tracking(), entity: str = "rec", order: str = "i", at: tuple[str, ...] = ("x", "y", "z", "palm_x", "palm_y", "palm_z")) -> DataFrame:
    """Adds slot (0 or 1) to detections (entity, order, k, label and coordinates of wrist and palm), two at most per frame; frames without any keep identities.

    One loop over the frames of a sequence's sorted arrays; a sequence has to fit a task. More than two detections in a frame raise.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in detections.schema)

    def whole(table: pa.Table) -> pa.Table:
        table = table.sort_by([(order, "ascending"), *((c, "ascending") for c in at), ("label", "ascending"), ("k", "ascending")])
        frame = table[order].to_numpy()
        places, labels = np.stack([table[c].to_numpy() for c in at], axis=1), table["label"].to_pylist()
        edges = [*np.flatnonzero(np.diff(frame, prepend=frame[0] - 1)).tolist(), len(frame)]
        if max(np.diff(edges), default=0) > 2:
            raise ValueError("more than two detections in a frame")
        slots, held = [], Slots(rule)
        for a, b in zip(edges, edges[1:]):
            slots += held.assign(places[a:b], labels[a:b], list(range(b - a)))
        return table.append_column("slot", pa.array(slots, pa.int32()))

    return detections.groupBy(entity).applyInArrow(whole, f"{fields}, slot int")
