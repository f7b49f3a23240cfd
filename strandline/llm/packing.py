"""Cost-balanced packing of token sequences.

A document's cost is estimated as linear plus quadratic (attention) work in its length. Within a shard, documents in
descending order go to the sequence of lowest cost among those with room, so that sequences are both full and
alike in cost.
"""

from __future__ import annotations

import functools
import math
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WordIndex, byte_column, distinct, slices, split_words, stage

#: A run of letters, and at most one run of marks after it, without what could begin a contraction, a special token or a composition.
_PLAIN = regex.compile(r"\p{L}+([^\s\p{L}\p{N}\p{M}'<]*)")


class WordIds:
    """Token ids of words as one flat array, by the library; white space parts tokens, so a text's ids are those of its words."""

    def __init__(self, path: str, known: int = 800_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.index = Tokenizer.from_file(path), WordIndex(known)
        names = self.tokenizer.get_vocab()
        self.last = np.zeros(max(names.values()) + 1, bool)
        self.last[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.flat, self.ends = np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def __call__(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids known, and where those of each word begin and end."""
        if (kept := self.index.make_room()) is not None:
            begin, end = self.ends[kept], self.ends[kept + 1]
            self.flat, self.ends = gather(self.flat, begin, end), np.r_[0, np.cumsum(end - begin)]
        if new := self.index.unknown(words):
            # plain words go to the library many at a time; how many end marks each has tells their ids apart
            parts: list[list[tuple[bytes, str]]] = [[], [], []]
            for w in new:
                text = w.decode("utf-8", "replace")
                plain = _PLAIN.fullmatch(text)
                parts[0 if not plain else 2 if plain[1] else 1].append((w, text))
            learnt = []
            for marks, part in enumerate(parts):
                step = 1024 if marks else max(1, len(part))
                learnt += [self._ids([text for _, text in part[k : k + step]], marks) for k in range(0, len(part), step)]
            self.index.add([w for part in parts for w, _ in part])
            sizes = np.concatenate([size for _, size in learnt])
            self.ends = np.append(self.ends, self.ends[-1] + np.cumsum(sizes))
            self.flat = np.concatenate([self.flat, *(flat for flat, _ in learnt)])
        at = self.index.at(words)
        return self.flat, self.ends[at], self.ends[at + 1]

    def _ids(self, texts: list[str], marks: int) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words and how many each has; each is of `marks` pre-tokens if that isn't 0."""
        if marks:
            flat = np.array(self.tokenizer.encode_batch_fast([" ".join(texts)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[flat])
            if len(ends) == marks * len(texts):
                return flat, np.diff(np.r_[0, ends[marks - 1 :: marks] + 1])
        each = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return np.fromiter((i for x in each for i in x), np.uint32), np.array([len(x) for x in each], np.int64)


@functools.lru_cache(maxsize=1)
def word_ids(path: str, known: int) -> WordIds:
    """One per worker process: the tasks it runs one after the other share what was learnt."""
    return WordIds(path, known)


def gather(flat: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The concatenation of flat[begin[k]:end[k]]."""
    size = end - begin
    skip = np.cumsum(size) - size
    return flat[np.repeat(begin - skip, size) + np.arange(size.sum())]


def token_pieces(docs: DataFrame, tokenizer: str, room: int = 4096, stop_id: int = 2, text: str = "text", id_col: str = "doc_id", known_words: int = 800_000, slice_bytes: int = 2 << 20) -> DataFrame:
    """Each document's ids, with stop_id after them, cut into pieces of `room` ids and a rest.

    Returns doc_id, start, length, ids_crc32 (of little-endian unsigned 32-bit ids), doc_tokens. A null or empty text is
    the stop id alone. A worker remembers known_words words and works on slice_bytes of text at a time: these bound its memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = word_ids(tokenizer, known_words)
        for batch in batches:
            texts = byte_column(batch.column(1))
            for first, last in slices(texts, slice_bytes):
                words, per_text = split_words(texts.slice(first, last - first), lower=True)
                codes, names = distinct(words)
                flat, begin, end = ids_of(names)
                ids = gather(flat, begin[codes], end[codes]) if words else np.zeros(0, np.uint32)
                size = (end - begin)[codes] if words else np.zeros(0, np.int64)
                upto = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(per_text)]]
                rows: list[tuple[int, int, int, int, int]] = []
                for k in range(last - first):
                    own = np.append(ids[upto[k] : upto[k + 1]], np.uint32(stop_id)).astype("<u4")
                    rows += [(first + k, s, min(room, len(own) - s), zlib.crc32(own[s : s + room].tobytes()), len(own)) for s in range(0, len(own), room)]
                table = np.array(rows, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(table[:, 0])), *(pa.array(table[:, c]) for c in range(1, 5))], names=[id_col, "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint")


def balanced(lengths: np.ndarray, room: int, linear: float, quadratic: float) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each piece; `lengths` must not rise."""
    count = max(1, math.ceil(lengths.sum() / room))
    spare, cost = np.full(count, room, np.int64), np.zeros(count)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for k, n in enumerate(lengths.tolist()):
        at = int(np.argmin(np.where(spare >= n, cost, np.inf)))
        if spare[at] < n:
            at = len(spare)
            spare, cost = np.append(spare, room), np.append(cost, 0.0)
        bins[k], offsets[k] = at, room - spare[at]
        spare[at] -= n
        cost[at] += linear * n + quadratic * n * n
    return bins, offsets


def pack(pieces: DataFrame, room: int = 4096, linear: float = 1.0, quadratic: float = 1 / 4096, shard_rows: int = 20_000, id_col: str = "doc_id") -> DataFrame:
    """Adds sequence_id and offset to pieces of at most `room` ids.

    Pieces are dealt by hash to shards of about shard_rows, so that no task sees more however many there are; each shard fills
    its own sequences (sequence_id = shard * 2^32 + number). Order and ties are settled by (length, id, start, crc), so
    reruns agree. An empty table gives an empty result; `pieces` is read twice and should be a written table.
    """
    shards = max(1, math.ceil(pieces.count() / shard_rows))
    dealt = pieces.withColumn("_shard", F.pmod(F.xxhash64(id_col, "start", "ids_crc32", "length"), F.lit(shards)))
    out = [*pieces.columns, "sequence_id", "offset"]

    def fill(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", id_col, "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        bins, offsets = balanced(rows["length"].to_numpy(np.int64), room, linear, quadratic)
        return rows.assign(sequence_id=int(key[0]) * (1 << 32) + bins, offset=offsets)[out]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return dealt.groupBy("_shard").applyInPandas(fill, f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str, room: int = 4096, text: str = "text", id_col: str = "doc_id", known_words: int = 800_000, slice_bytes: int = 2 << 20) -> DataFrame:
    """Pieces of all documents with their place: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Null texts are empty; repeated rows are packed each, and equal lengths go by id; a very long text is many pieces; columns other than id and
    text are left out. known_words and slice_bytes bound a worker's memory (see token_pieces).
    """
    return pack(stage(token_pieces(docs, tokenizer, room, text=text, id_col=id_col, known_words=known_words, slice_bytes=slice_bytes), "pieces"), room, id_col=id_col)
