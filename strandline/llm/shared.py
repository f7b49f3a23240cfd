"""What several operators share: the folder for intermediate tables, and views of texts as byte arrays."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts of a batch are worked on in slices of about this many bytes, so that a worker's memory doesn't follow the batch.
SLICE_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a local session without one gets its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def stage(df: DataFrame, name: str) -> DataFrame:
    """df written as a Parquet table in the shared folder and read again: its lineage ends there, and a lost executor takes nothing with it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """From now on Arrow batches hold about so many bytes. JVM and worker each hold a batch and copies of its columns, and texts are worked on in slices of SLICE_BYTES anyway."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def held_out(doc_id: Column) -> Column:
    """Whether a row belongs to the held-out fifth: crc32 of its id as text is divisible by 5. A null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def byte_column(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A text column as binary without nulls (a null text is empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.cast(pa.large_binary()).fill_null(b"")


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `limit` bytes each; one very long text is a range of its own."""
    ends = np.cumsum(np.diff(np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1])) if len(texts) else np.zeros(0, np.int64)
    start = 0
    while start < len(ends):
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield start, stop
        start = stop


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, one after the other, and the offset of each text (one more than there are texts)."""
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    flat = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return flat[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes other than space and 0x09-0x0D, within its text, and the text's index."""
    ink = ~((flat == 32) | ((flat >= 9) & (flat <= 13)))
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(flat))]
    first[edges] |= ink[edges]
    last[edges - 1] |= ink[edges - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(offsets, starts, side="right") - 1


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values (the finalizer of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BASE = 0x9E3779B97F4A7C15 | 1
_BYTES = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_to(n: int) -> list[np.ndarray]:
    if len(_powers[0]) < n:
        for k, base in enumerate((_BASE, pow(_BASE, -1, 1 << 64))):
            p = np.full(n, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers


def span_hashes(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans: differences of one running polynomial sum, shifted to a common origin."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = _powers_to(len(flat) + 1)
    total = np.zeros(len(flat) + 1, np.uint64)
    np.cumsum(_BYTES[flat] * up[: len(flat)], out=total[1:])
    return mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def split_words(texts: pa.Array, lower: bool = False) -> tuple[list[bytes], np.ndarray]:
    """All words (runs of bytes other than space and 0x09-0x0D) in order, and how many each text has.

    With `lower`, A-Z become a-z, for users that lower them anyway; texts with `<|` stay, as special tokens keep case.
    """
    words: list[bytes] = []
    counts = np.zeros(len(texts), np.int64)
    for k, text in enumerate(texts.to_pylist()):
        own = (text.lower() if lower and b"<|" not in text else text).split()  # for bytes: exactly space and 0x09-0x0D
        counts[k] = len(own)
        words += own
    return words, counts


def distinct(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each word the index of its first equal among the distinct words, and those."""
    import pandas as pd

    array = np.empty(len(words), object)
    array[:] = words
    return pd.factorize(array)


class WordIndex:
    """Row numbers of words, kept between slices within a bound; when it is full, words met in one slice only are forgotten first."""

    def __init__(self, most: int = 300_000):
        self.most, self.rows, self.hits = most, {}, np.zeros(0, np.int64)

    def make_room(self) -> np.ndarray | None:
        """The old rows that stay, in their new order, if rows had to go."""
        if len(self.rows) <= self.most:
            return None
        order = np.argsort(-self.hits, kind="stable")[: self.most // 2]
        kept = order[self.hits[order] > 1]
        place = np.full(len(self.hits), -1, np.int64)
        place[kept] = np.arange(len(kept))
        self.rows = {w: int(place[k]) for w, k in self.rows.items() if place[k] >= 0}
        self.hits = self.hits[kept] // 2 + 1
        return kept

    def unknown(self, words: np.ndarray) -> list[bytes]:
        return [w for w in words if w not in self.rows]

    def add(self, words: list[bytes]) -> None:
        self.rows.update(zip(words, range(len(self.rows), len(self.rows) + len(words)), strict=True))
        self.hits = np.append(self.hits, np.zeros(len(words), np.int64))

    def at(self, words: np.ndarray) -> np.ndarray:
        found = np.fromiter((self.rows[w] for w in words), np.int64, len(words))
        self.hits[found] += 1
        return found
