"""Events of a stream together with their frames: a detector and a bounded frame buffer per sequence, as keyed state with timers."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from ..operators.events import EVENT_SCHEMA, Limits, State, finish, step

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_EVENT = [x.split()[0] for x in EVENT_SCHEMA.split(", ")]
OBSERVED = ("hand_present", "quality_ok", "motion_q")


def retention(limits: Limits, before: int = 0) -> int:
    """How long a frame can still belong to an event that hasn't ended: an event of full length, its pre-roll, what settles it and a gap that breaks it."""
    return limits.most_event + limits.pre_roll + limits.finalization + limits.gap_time + before


@contextmanager
def list_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in the store that list and map state need; the session's own choice comes back after."""
    own = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, own)


class _Buffered(StatefulProcessor):
    """Detector state as one value, frames as a list. A timer at the sequence's last event time + idle_ms ends it."""

    def __init__(self, frame: StructType, limits: Limits, idle_ms: int, event_time: str, before: int):
        self.frame, self.limits, self.idle_ms, self.event_time, self.before = frame, limits, idle_ms, event_time, before

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.detector = handle.getValueState("detector", "text string")
        self.frames = handle.getListState("frames", self.frame)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = State.of(self.detector.get()[0] if self.detector.exists() else None)
        batch = pd.concat(list(rows), ignore_index=True).sort_values(["t", *OBSERVED])
        if state.t is not None:
            batch = batch[batch["t"] > state.t]  # what is late for the detector is late for its frames
        if batch.empty:
            return
        held = list(self.frames.get()) if self.frames.exists() else []
        held += list(batch[self.frame.names].astype(object).itertuples(index=False, name=None))
        first = batch.drop_duplicates("t")
        found = [e for t, *seen in first[["t", *OBSERVED]].itertuples(index=False) if (e := step(state, self.limits, int(t), bool(seen[0]), bool(seen[1]), int(seen[2])))]
        at = self.frame.names.index("t")
        out = self._with_frames(key, found, held)
        oldest = state.t - retention(self.limits, self.before)
        self.frames.put([f for f in held if f[at] >= oldest])
        self.detector.update((state.text(),))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int(batch[self.event_time].max().timestamp() * 1000) + self.idle_ms)
        if len(out):
            yield out

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.detector.exists():
            last = finish(State.of(self.detector.get()[0]), self.limits)
            out = self._with_frames(key, [last] if last else [], list(self.frames.get()) if self.frames.exists() else [])
            self.detector.clear()
            self.frames.clear()
            if len(out):
                yield out

    def _with_frames(self, key: tuple, events: list[tuple], frames: list[tuple]) -> pd.DataFrame:
        at = self.frame.names.index("t")
        rows = [(key[0], *e, *f) for e in events for f in frames if e[2] - self.before <= f[at] <= e[3]]
        return pd.DataFrame(rows, columns=[*_EVENT, *(f"frame_{n}" for n in self.frame.names)])

    def close(self) -> None:
        pass


def events_with_frames_stream(frames: DataFrame, keep: tuple[str, ...] = ("i",), limits: Limits = Limits(), idle_ms: int = 60_000, event_time: str = "at", before: int = 0) -> DataFrame:
    """A row for each frame of each event of a stream of (rec, t, hand_present, quality_ok, motion_q, at and the columns to keep) with a watermark on at.

    Columns: those of detect_events, frame_t and frame_<column> of what is kept. A sequence's state holds the frames of `retention` and no
    more; frames `before` microseconds ahead of an event come with it. Rows at or before a sequence's last time are left out. When event time has passed a sequence by idle_ms, its open
    event closes as stream_end and its state goes. Start the query inside `list_state`.
    """
    frame = StructType([frames.schema["t"], *(frames.schema[c] for c in keep)])
    fields = ", ".join([EVENT_SCHEMA, *(f"frame_{f.name} {f.dataType.simpleString()}" for f in frame)])
    return frames.groupBy("rec").transformWithStateInPandas(_Buffered(frame, limits, idle_ms, event_time, before), fields, "Append", "EventTime")
