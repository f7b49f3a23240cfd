"""A quality classifier: histogram gradient-boosted trees over document statistics.

The trees are fitted on the driver from a bounded sample of labelled rows and then flattened into arrays, level by
level, so that a batch goes through all trees by numpy indexing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import byte_column, held_out, raw_bytes, slices, span_hashes, word_spans

_KINDS = ("lower", "upper", "digit", "stop", "mark", "shout", "bar", "bracket", "other", "beyond", "line", "blank")
FEATURES = ("log_bytes", "log_words", "mean_word", "longest_word", *(f"share_{k}" for k in _KINDS), "distinct_words", "distinct_lines", "words_per_line", "upper_words", "marked_words", "shouted_words", "short_words", "log_lines")


def _kinds() -> np.ndarray:
    table = np.full(256, _KINDS.index("other"), np.uint8)
    for kind, characters in {"lower": "abcdefghijklmnopqrstuvwxyz", "upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digit": "0123456789", "stop": ".,;:?'\"", "mark": "*#$%&@^~=+", "shout": "!", "bar": "|", "bracket": "()[]{}<>/\\_", "line": "\n", "blank": " \t\r\v\f"}.items():
        table[np.frombuffer(characters.encode(), np.uint8)] = _KINDS.index(kind)
    table[128:] = _KINDS.index("beyond")
    return table


_TABLE = _kinds()


def _distinct_share(hashes: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """Distinct hashes over all, by owner; 1 where there are none."""
    total = np.bincount(owner, minlength=count)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    return np.where(total > 0, np.bincount(o[new], minlength=count) / np.maximum(total, 1), 1.0)


def statistics(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES per text, from its whole bytes."""
    flat, offsets = raw_bytes(texts)
    n, size = len(texts), np.diff(offsets)
    doc = np.repeat(np.arange(n), size)
    kind = _TABLE[flat]
    by_kind = np.bincount(doc * len(_KINDS) + kind, minlength=n * len(_KINDS)).reshape(n, len(_KINDS))
    starts, ends, owner = word_spans(flat, offsets)
    words = np.bincount(owner, minlength=n)
    length = ends - starts
    longest = np.zeros(n)
    np.maximum.at(longest, owner, length)
    per_word = np.maximum(words, 1)
    share = lambda flag: np.bincount(owner, flag, n) / per_word
    last = kind[ends - 1] if len(ends) else kind[:0]
    first = kind[starts] if len(starts) else kind[:0]
    breaks = np.flatnonzero(flat == 10)
    # a break at a text's end opens no line
    inner = breaks + 1 < offsets[np.searchsorted(offsets, breaks, side="right")]
    line_starts = np.sort(np.concatenate([offsets[:-1][size > 0], breaks[inner] + 1]))
    line_owner = np.searchsorted(offsets, line_starts, side="right") - 1
    next_break = np.append(breaks, len(flat))[np.searchsorted(breaks, line_starts)]
    line_ends = np.maximum(np.minimum(next_break, offsets[line_owner + 1]), line_starts)
    lines = np.bincount(line_owner, minlength=n)
    return np.column_stack([
        np.log1p(size), np.log1p(words), np.bincount(owner, length, n) / per_word, np.log1p(longest), by_kind / np.maximum(size, 1)[:, None],
        _distinct_share(span_hashes(flat, starts, ends), owner, n), _distinct_share(span_hashes(flat, line_starts, line_ends), line_owner, n), np.log1p(words / np.maximum(lines, 1)),
        share(first == _KINDS.index("upper")), share(last == _KINDS.index("mark")), share(last == _KINDS.index("shout")), share(length <= 2), np.log1p(lines),
    ])


@dataclass
class Forest:
    """Trees of one depth as arrays: node k of a level has children 2k and 2k+1 of the next."""

    feature: np.ndarray  # trees x inner nodes
    limit: np.ndarray
    leaf: np.ndarray  # trees x leaves
    base: float
    depth: int

    def margin(self, rows: np.ndarray) -> np.ndarray:
        out = np.full(len(rows), self.base)
        line = np.arange(len(rows))
        for feature, limit, leaf in zip(self.feature, self.limit, self.leaf, strict=True):
            node = np.zeros(len(rows), np.int64)
            for level in range(self.depth):
                at = (1 << level) - 1 + node
                node = 2 * node + (rows[line, feature[at]] > limit[at])
            out += leaf[node]
        return out

    def probability(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(rows)))


def grow(rows: np.ndarray, labels: np.ndarray, trees: int = 60, depth: int = 4, bins: int = 64, rate: float = 0.15, ridge: float = 1.0, least: float = 5.0) -> Forest:
    """Gradient boosting of the logistic loss; splits are searched over histograms of quantile bins."""
    n, width = rows.shape
    share = float(np.clip(labels.mean() if n else 0.5, 1e-3, 1 - 1e-3))
    base = np.log(share / (1 - share))
    cuts = [np.unique(np.quantile(rows[:, c], np.linspace(0, 1, bins + 1)[1:-1])) if n else np.zeros(0) for c in range(width)]
    code = np.column_stack([np.searchsorted(cuts[c], rows[:, c], side="left") for c in range(width)]) if n else np.zeros((0, width), int)
    cells = code + np.arange(width) * bins
    margin = np.full(n, base)
    features, limits, leaves = [], [], []
    for _ in range(trees if n else 0):
        p = 1 / (1 + np.exp(-margin))
        gradient, curve = labels - p, p * (1 - p)
        feature, limit = np.zeros((1 << depth) - 1, np.int64), np.full((1 << depth) - 1, np.inf)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            many = 1 << level
            key = (node[:, None] * (width * bins) + cells).ravel()
            g = np.bincount(key, np.repeat(gradient, width), many * width * bins).reshape(many, width, bins).cumsum(2)
            h = np.bincount(key, np.repeat(curve, width), many * width * bins).reshape(many, width, bins).cumsum(2)
            all_g, all_h = g[:, :, -1:], h[:, :, -1:]
            gain = g**2 / (h + ridge) + (all_g - g) ** 2 / (all_h - h + ridge) - all_g**2 / (all_h + ridge)
            gain[(h < least * 0.25) | (all_h - h < least * 0.25)] = -1
            flat = gain.reshape(many, -1)
            best = flat.argmax(1)
            for k in range(many):
                c, b = divmod(int(best[k]), bins)
                if flat[k, best[k]] > 1e-6 and b < len(cuts[c]):
                    feature[many - 1 + k], limit[many - 1 + k] = c, cuts[c][b]
            at = many - 1 + node
            node = 2 * node + (rows[np.arange(n), feature[at]] > limit[at])
        leaf = rate * np.bincount(node, gradient, 1 << depth) / (np.bincount(node, curve, 1 << depth) + ridge)
        margin += leaf[node]
        features.append(feature), limits.append(limit), leaves.append(leaf)
    shape = (len(features), -1) if features else (0, 1)
    return Forest(np.array(features).reshape(shape), np.array(limits).reshape(shape), np.array(leaves).reshape(shape), float(base), depth)


def fit_quality(docs: DataFrame, labels: DataFrame, most_rows: int = 20_000, label: str = "quality") -> Forest:
    """A forest from the labelled rows that aren't held out: about most_rows of them, chosen by a hash of the id.

    That bound is what limits the driver's share; rows with a null label or id take no part, several labels of a row
    count each. Without labelled rows every score is 0.5.
    """
    known = labels.where(~held_out(F.col("doc_id")) & F.col(label).isNotNull()).select("doc_id", F.col(label).cast("double").alias("_label"))
    # about most_rows labels go to the texts, which stay where they are
    draw = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1_000_000))
    chosen = known.where(draw < int(1_000_000 * min(1.0, most_rows / max(1, known.count()))) + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_column(batch.column(1))
            for start, stop in slices(texts):
                rows = statistics(texts.slice(start, stop - start))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), batch.column(2).slice(start, stop - start), pa.array(list(rows), pa.list_(pa.float64()))], names=["doc_id", "label", "features"])

    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(run, "doc_id bigint, label double, features array<double>").toPandas()
    found = found.sort_values(["doc_id", "label"], kind="stable")
    rows = np.stack(found["features"].to_numpy()) if len(found) else np.zeros((0, len(FEATURES)))
    return grow(rows, (found["label"].to_numpy(float) >= 0.5).astype(float))


def score_quality(docs: DataFrame, forest: Forest, threshold: float = 0.3, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: id, score (probability of label 1) and predicted (1 if score >= threshold). Null and empty texts are scored alike, equal rows equally, and texts of any length whole; an empty table gives none; other columns are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = byte_column(batch.column(1))
            for start, stop in slices(texts, 1 << 20):
                score = forest.probability(statistics(texts.slice(start, stop - start)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(run, f"`{id_col}` {kind}, score double, predicted int")
