"""Buffered events on a stream: equal to the batch join, and state that stays within its retention."""

from datetime import datetime, timedelta

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from strandline.operators import events as E
from strandline.sources.staging import new_path
from strandline.streaming import buffers as B
from strandline.streaming import ledger as L

EPOCH = datetime(2020, 1, 1)
SCHEMA = "rec bigint, i bigint, t bigint, hand_present boolean, quality_ok boolean, motion_q bigint, at timestamp"


class Value:
    def __init__(self):
        self.now = None

    def exists(self):
        return self.now is not None

    def get(self):
        return self.now

    def update(self, value):
        self.now = value

    put = update

    def clear(self):
        self.now = None


class Handle:
    """State in memory, to see what a processor keeps."""

    def __init__(self):
        self.timers = []

    def getValueState(self, name, schema):
        return Value()

    getListState = getValueState

    def listTimers(self):
        return self.timers

    def deleteTimer(self, timer):
        self.timers.remove(timer)

    def registerTimer(self, timer):
        self.timers.append(timer)


def rows(n, rec=1, step=33_333):
    """Motion for a second, stillness for a second, and so on, with frames that miss the hand."""
    return [(rec, k, k * step, k % 41 != 7, True, 900_000 if k // 30 % 2 else 0, EPOCH + timedelta(microseconds=k * step)) for k in range(n)]


def test_the_buffer_stays_within_its_retention(spark):
    frames = spark.createDataFrame(rows(1), SCHEMA)
    limits = E.Limits()
    p = B._Buffered(StructType([frames.schema["t"], frames.schema["i"]]), limits, 1000, "at", 50_000)
    handle = Handle()
    p.init(handle)
    most = B.retention(limits, 50_000) // 33_333 + 1
    data = pd.DataFrame(rows(3000), columns=[x.split()[0] for x in SCHEMA.split(", ")])
    out = []
    for k in range(0, 3000, 100):
        out += [x for d in p.handleInputRows((1,), iter([data.iloc[k : k + 60], data.iloc[k + 60 : k + 100]]), None) for x in d.itertuples(index=False, name=None)]
        assert len(p.frames.get()) <= most + 100 and len(handle.timers) == 1
    held = p.frames.get()
    assert len(held) <= most and held[-1][1] == 2999
    out += [x for d in p.handleExpiredTimer((1,), None, None) for x in d.itertuples(index=False, name=None)]
    assert not p.frames.exists() and not p.detector.exists()
    found = E.events_with_frames(E.detect_events(spark.createDataFrame(rows(3000), SCHEMA), limits), spark.createDataFrame(rows(3000), SCHEMA).select("rec", "i", "t"), before=50_000)
    want = [tuple(r) for r in found.select("rec", "first_t", "last_t", "reason", "t", "i").collect()]
    assert len(want) > 100 and sorted((o[0], *o[3:]) for o in out) == sorted(want)


@pytest.mark.parametrize("parts", [1, 3])
def test_stream_equals_batch(spark, parts):
    data = spark.createDataFrame([x for rec in (1, 2, 3) for x in rows(200 + 40 * rec, rec)] + rows(100, 2), SCHEMA)  # recording 2 repeats its first rows
    beat = spark.createDataFrame([(-1, 0, 0, False, False, 0, datetime(2250, 1, 1))] * 2, SCHEMA)
    source, sink, marks = (new_path(spark, x) for x in ("in", "out", "marks"))
    for k in range(parts + 2):
        part = beat.limit(1) if k >= parts else data.where((F.col("i") >= 300 / parts * k) & (F.col("i") < (300 / parts * (k + 1) if k < parts - 1 else 10**9)))
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source).withWatermark("at", "40000 days")
        out = B.events_with_frames_stream(stream, ("i", "motion_q"), idle_ms=10**9)
        with B.list_state(spark):
            out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", marks).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.schema(out.schema).parquet(sink)
    want = E.events_with_frames(E.detect_events(data), data.select("rec", "i", "t", "motion_q"))
    pick = lambda df, i, m, t: sorted(tuple(r) for r in df.select("rec", "first_t", "last_t", "reason", t, i, m).collect())
    assert pick(got, "frame_i", "frame_motion_q", "frame_t") == pick(want, "i", "motion_q", "t")
    assert "RocksDB" not in spark.conf.get(B._PROVIDER)


def ledger_batches(spark, batches):
    """Statuses by batch, and the progress of each."""
    schema = "k bigint, c string, s string"
    source, ledger, marks = (new_path(spark, x) for x in ("in", "ledger", "marks"))
    progress = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        with B.list_state(spark):
            q = L.write_ledger(spark.readStream.schema(schema).parquet(source), ledger, marks, "k", "c", "s").trigger(availableNow=True).start()
            q.awaitTermination()
        progress += [p for p in q.recentProgress if p["numInputRows"]]
    return sorted(tuple(r) for r in spark.read.parquet(ledger).select("k", "c", "s", F.col("status").cast("string")).collect()), progress


def test_ledger_reads_its_batch_only(spark):
    size = 50
    batches = [[(size * b + k, "c", f"s{size * b + k}") for k in range(size)] for b in range(3)] + [[(3, "c", "s3"), (4, "other", "s4"), (999, "c", "s5"), (1000, "b", "new"), (1000, "a", "new"), (1001, "a", "new")]]
    got, progress = ledger_batches(spark, batches)
    want = [(*r, "new") for b in batches[:3] for r in b] + [(3, "c", "s3", "unchanged"), (4, "other", "s4", "conflict"), (999, "c", "s5", "conflict"), (1000, "a", "new", "new"), (1000, "b", "new", "conflict"), (1001, "a", "new", "conflict")]
    assert got == sorted(want)
    assert [p["numInputRows"] for p in progress] == [size] * 3 + [6]
    touched = [sum(o["numRowsUpdated"] for o in p["stateOperators"]) for p in progress]
    assert touched[0] == touched[1] == touched[2] and touched[3] < touched[0]  # state grows, what a batch changes doesn't
    assert all(len(p["sources"]) == 1 for p in progress)


def test_a_batch_asks_the_state_once_a_cell_and_not_once_a_name():
    import pandas as pd

    from strandline.streaming.ledger import _FirstClaim

    class Claims(dict):
        asked = 0

        def getValue(self, key):
            self.asked += 1
            return self.get(key)

        def updateValue(self, key, value):
            self[key] = value

    claim = _FirstClaim("k", "c", ["k", "c"], "key", 3)
    claim.claims = Claims()
    rows = pd.DataFrame({"k": [f"n{i}" for i in range(300)] * 2, "c": ["b"] * 300 + ["a"] * 300})
    (got,) = claim.handleInputRows((0,), iter([rows[:100], rows[100:]]), None)
    assert claim.claims.asked == 3
    assert got["key_agrees"].tolist() == got["key_first"].tolist() == [False] * 300 + [True] * 300
    (again,) = claim.handleInputRows((0,), iter([rows]), None)
    assert claim.claims.asked == 6 and again["key_agrees"].tolist() == [False] * 300 + [True] * 300 and not again["key_first"].any()
