"""Token counts by rank-synchronous array merging.

The distinct pre-tokens of a batch are held as one ragged numpy array of symbols. In each round every sequence
that still has a pair with a merge rank applies its lowest-ranked pair at all its places at once; a sequence
without such a pair is finished and leaves. What counts is how many symbols survive.
"""

from __future__ import annotations

import functools
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .shared import WordIndex, byte_column, distinct, slices, split_words

def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    names = {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [names[b] for b in range(256)]


class MergeTable:
    """The merges of a byte-pair vocabulary with an end-of-word suffix, as sorted arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, vocab = spec["model"], spec["model"]["vocab"]
        if model.get("continuing_subword_prefix") or model.get("byte_fallback") or model.get("ignore_merges"):
            raise ValueError("only vocabularies whose merges alone decide are supported")
        suffix = model.get("end_of_word_suffix") or ""
        names = byte_symbols()
        self.inner = np.array([vocab[c] for c in names], np.int64)
        self.final = np.array([vocab[c + suffix] for c in names], np.int64)
        pairs = [tuple(m) if not isinstance(m, str) else tuple(m.split(" ")) for m in model["merges"]]
        self.width = 1 << 20
        keys = np.array([vocab[a] * self.width + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank = keys[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        self.special = [t["content"] for t in spec["added_tokens"]]
        self._special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self._pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])

    def pre_tokens(self, word: bytes) -> tuple[list[bytes], int]:
        """The byte strings that are merged each for itself, and the number of special tokens met."""
        text = word.decode("utf-8", "replace")
        parts, special = [text], 0
        if self._special is not None and any(s in text for s in self.special):
            parts, special = self._special.split(text), len(self._special.findall(text))
        found: list[bytes] = []
        for part in parts:
            # characters are lowered one by one, so that no rule looks at their neighbours
            part = unicodedata.normalize("NFC", part)
            part = part.lower() if part.isascii() else "".join(map(str.lower, part))
            found += [x.encode() for x in self._pattern.findall(part)]
        return found, special

    def count(self, tokens: list[bytes]) -> np.ndarray:
        """How many symbols of each byte string survive."""
        lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        counts = np.zeros(len(tokens), np.int64)
        flat = np.frombuffer(b"".join(tokens), np.uint8)
        owner = np.repeat(np.arange(len(tokens)), lengths)
        symbols = self.inner[flat]
        ends = np.cumsum(lengths)[lengths > 0] - 1
        symbols[ends] = self.final[flat[ends]]
        none = len(self.made)
        while len(symbols):
            together = owner[1:] == owner[:-1]
            key = np.where(together, symbols[:-1] * self.width + symbols[1:], -1)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            rank = np.append(np.where(self.keys[at] == key, self.rank[at], none), none)
            heads = np.flatnonzero(np.r_[True, ~together])
            sizes = np.diff(np.r_[heads, len(symbols)])
            best = np.minimum.reduceat(rank, heads)
            done = best == none
            counts[owner[heads[done]]] = sizes[done]
            best = np.repeat(best, sizes)
            hit = (rank == best) & (best < none)
            # of overlapping places (one symbol thrice and more) every second is taken, from the left
            place = np.flatnonzero(hit)
            if len(place) > 1:
                run = np.r_[True, np.diff(place) != 1]
                step = np.arange(len(place)) - np.maximum.accumulate(np.where(run, np.arange(len(place)), 0))
                hit[place[step % 2 == 1]] = False
            symbols = np.where(hit, self.made[np.minimum(rank, none - 1)], symbols)
            keep = ~np.repeat(done, sizes)
            keep[1:] &= ~hit[:-1]
            symbols, owner = symbols[keep], owner[keep]
        return counts


class WordCounter:
    """Token counts of words, remembered between batches within a bound."""

    def __init__(self, path: str):
        self.table, self.index, self.counts = MergeTable(path), WordIndex(), np.zeros(0, np.int64)

    def __call__(self, words: np.ndarray) -> np.ndarray:
        if (kept := self.index.make_room()) is not None:
            self.counts = self.counts[kept]
        if new := self.index.unknown(words):
            pieces = [self.table.pre_tokens(w) for w in new]
            flat = [t for own, _ in pieces for t in own]
            codes, tokens = distinct(flat)
            each = self.table.count(list(tokens))[codes] if flat else np.zeros(0, np.int64)
            sums = np.r_[0, np.cumsum(each)]
            ends = np.cumsum([len(own) for own, _ in pieces])
            self.index.add(new)
            self.counts = np.append(self.counts, sums[ends] - sums[np.r_[0, ends[:-1]]] + np.array([special for _, special in pieces]))
        return self.counts[self.index.at(words)]


@functools.lru_cache(maxsize=1)
def word_counter(path: str) -> WordCounter:
    """One per worker process: the tasks it runs one after the other share what was learnt."""
    return WordCounter(path)


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row of docs: its id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    White space parts pre-tokens in such vocabularies, so the distinct words of a slice are counted once and
    summed by row; nothing is shuffled. A null text has no tokens; equal ids and equal texts stay rows of their own;
    other columns are left out. `tokenizer` is a file that every executor can read (a vocabulary installed there).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = word_counter(tokenizer)
        for batch in batches:
            texts = byte_column(batch.column(1))
            for start, stop in slices(texts):
                part = texts.slice(start, stop - start)
                words, per_text = split_words(part, lower=True)
                codes, names = distinct(words)
                each = counter(names)[codes] if words else np.zeros(0, np.int64)
                sums = np.r_[0, np.cumsum(each)]
                ends = np.cumsum(per_text)
                tokens = sums[ends] - sums[ends - per_text]
                size = np.fromiter(map(len, part.to_pylist()), np.int64, len(part))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array(size), pa.array(tokens), pa.array(tokens > limit)], names=[id_col, "n_bytes", "n_tokens", "over_limit"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
