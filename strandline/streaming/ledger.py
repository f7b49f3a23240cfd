"""A ledger of attempts as keyed state: what a batch reads and writes follows the batch, not the ledger."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class _FirstClaim(StatefulProcessor):
    """Of the rows of each name the first value ever met stays; adds whether a row is met for the first time (`first`) and whether it agrees (`agrees`).

    A map state holds the claims of a cell of names as one JSON object, so that a batch reads and writes each cell of its own names once, however many
    of them it has. Of several values of a name in one batch the smallest is taken, so that it doesn't matter how rows arrive.
    """

    def __init__(self, group: str, value: str, names: list[str], mark: str, cells: int):
        self.group, self.value, self.names, self.mark, self.cells = group, value, names, mark, cells

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.claims = handle.getMapState("claims", "cell int", "claims string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows), ignore_index=True)
        names, values = batch[self.group].astype(str).tolist(), batch[self.value].astype(str).tolist()
        asked: dict[int, dict[str, str]] = {}
        for n, v in zip(names, values):
            least = asked.setdefault(zlib.crc32(n.encode()) % self.cells, {})
            if n not in least or v < least[n]:
                least[n] = v
        known, new = {}, set()
        for cell, least in asked.items():
            held = self.claims.getValue((cell,))
            claims = json.loads(held[0]) if held is not None else {}
            fresh = [n for n in least if n not in claims]
            if fresh:
                claims.update((n, least[n]) for n in fresh)
                self.claims.updateValue((cell,), (json.dumps(claims),))
                new.update(fresh)
            known.update((n, claims[n]) for n in least)
        batch = batch[self.names]
        agrees = pd.Series([known[n] == v for n, v in zip(names, values)], dtype=bool)
        first = agrees & pd.Series([n in new for n in names], dtype=bool) & ~batch.duplicated()
        yield batch.assign(**{f"{self.mark}_first": first, f"{self.mark}_agrees": agrees})

    def close(self) -> None:
        pass


def _claimed(rows: DataFrame, group: str, value: str, mark: str, buckets: int, cells: int) -> DataFrame:
    names = rows.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + f", {mark}_first boolean, {mark}_agrees boolean"
    dealt = rows.withColumn("_bucket", F.pmod(F.xxhash64(group), F.lit(buckets)))
    return dealt.groupBy("_bucket").transformWithStateInPandas(_FirstClaim(group, value, names, mark, cells), schema, "Append", "None")


def judged_attempts(stream: DataFrame, key: str, content: str, source: str, buckets: int = 64, cells: int = 1024) -> DataFrame:
    """Adds status to a stream of attempts: new, unchanged (the same key, content and source as before), or conflict (another content of a key, or a source that another key has).

    State is one content a key and one key a source, in the state store of each; the ledger itself isn't read. A key keeps the content
    it was first met with, a source its first key; of several in one batch the smallest. Replayed batches give the same rows, as state is
    versioned with the batch. Start the query inside `buffers.list_state`. A batch reads
    buckets x cells values at most, and for each of its names the names of its cell: choose cells so that a cell holds some hundreds. Rows with a null key, content or source take the text None as theirs.
    """
    by_key = _claimed(stream, key, content, "key", buckets, cells)
    by_source = _claimed(by_key, source, key, "source", buckets, cells)
    agrees = F.col("key_agrees") & F.col("source_agrees")
    status = F.when(~agrees, "conflict").when(F.col("key_first") | F.col("source_first"), "new").otherwise("unchanged")
    return by_source.withColumn("status", status).drop("key_first", "key_agrees", "source_first", "source_agrees")


def write_ledger(stream: DataFrame, path: str, checkpoint: str, key: str, content: str, source: str):
    """A query that appends judged attempts to a Parquet table partitioned by status; its log of committed files makes a replayed batch count once."""
    return judged_attempts(stream, key, content, source).writeStream.format("parquet").partitionBy("status").option("path", path).option("checkpointLocation", checkpoint)
