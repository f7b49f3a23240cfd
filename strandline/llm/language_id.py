"""Language identification by interpolated Kneser-Ney character models, one per language.

A model covers the letters of a word with its bounds (`^word$`), so a text's log-probability is the sum over its
words' and each distinct word of a slice is scored once. Per language and order, the n-grams' hashes are one
sorted array beside the interpolated log-probabilities; contexts beside their back-off weights likewise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import WordIndex, byte_column, distinct, held_out, mix64, slices, split_words

_LETTERS = regex.compile(r"\p{L}+")
_SEED = np.uint64(0x2545F4914F6CDD1D)


def letter_runs(word: bytes) -> list[str]:
    return _LETTERS.findall(word.decode("utf-8", "replace").lower())


def grams(runs: list[str], order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each predicted character (letters and the end mark) the hashes of its 1- to order-grams, shorter at a word's start (then 0), and its run."""
    text = "".join(f"^{r}$" for r in runs)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter((len(r) + 2 for r in runs), np.int64, len(runs))
    heads = np.cumsum(size) - size
    place = np.arange(len(codes)) - np.repeat(heads, size)
    owner = np.repeat(np.arange(len(runs)), size)
    keep = place > 0
    rolled = mix64(codes + _SEED)
    out = [rolled[keep]]
    for n in range(1, order):
        before = np.zeros_like(codes)
        before[n:] = codes[:-n]
        rolled = mix64(rolled * np.uint64(0x100000001B3) + before + np.uint64(n))
        out.append(np.where(place[keep] >= n, rolled[keep], np.uint64(0)))
    return out, owner[keep]


class Lookup:
    """A sorted array of hashes with a value each."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], values[order]

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.keys):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return self.values[at], self.keys[at] == keys


class KneserNey:
    """One language's model from counts of (gram, its context, its suffix) rows by order."""

    def __init__(self, counts: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]], order: int, alphabet: int):
        self.order, self.floor = order, -np.log(alphabet + 1)
        self.grams: list[Lookup] = []
        self.weights: list[Lookup] = []
        for n in range(1, order + 1):
            keys, contexts, suffixes, count = counts.get(n, (np.zeros(0, np.uint64),) * 3 + (np.zeros(0),))
            if n < order and n + 1 in counts:  # below the top: in how many contexts, besides grams at a word's start
                longer = counts[n + 1][2]
                names, kinds = np.unique(longer, return_counts=True)
                found, hit = Lookup(names, kinds.astype(float))(keys)
                count = np.where(hit, found, count)
            ones, twos = (count == 1).sum(), (count == 2).sum()
            discount = ones / (ones + 2 * twos) if ones and twos else 0.5
            names, group = np.unique(contexts, return_inverse=True)
            total = np.bincount(group, count, len(names)) if len(keys) else np.zeros(0)
            kinds = np.bincount(group, minlength=len(names)) if len(keys) else np.zeros(0)
            weight = discount * kinds / np.maximum(total, 1)
            lower = np.exp(self.log_prob(suffixes, n - 1)) if n > 1 and len(keys) else np.full(len(keys), np.exp(self.floor))
            prob = (count - discount) / total[group] + weight[group] * lower if len(keys) else np.zeros(0)
            self.grams.append(Lookup(keys, np.log(prob)))
            self.weights.append(Lookup(names, np.log(np.maximum(weight, 1e-12))))

    def log_prob(self, keys: np.ndarray, n: int) -> np.ndarray:
        """Of n-grams known to the model at training; unseen ones get the floor."""
        value, hit = self.grams[n - 1](keys)
        return np.where(hit, value, self.floor)

    def score(self, hashes: list[np.ndarray], contexts: list[np.ndarray]) -> np.ndarray:
        """Log-probability of each predicted character: the longest gram seen, or its shorter one times the context's weight."""
        value = np.full(len(hashes[0]), self.floor)
        for n in range(1, self.order + 1):
            there = hashes[n - 1] != 0
            weight, seen = self.weights[n - 1](contexts[n - 1])
            back = value + np.where(seen, weight, 0.0)
            own, hit = self.grams[n - 1](hashes[n - 1])
            value = np.where(there, np.where(hit, own, back), value)
        return value


def context_hashes(hashes: list[np.ndarray], runs: list[str]) -> list[np.ndarray]:
    """For each predicted character and order the hash of what precedes it within the gram."""
    # the context of an n-gram is the (n-1)-gram that ends one place before; at a word's first letter that is the start mark
    text = "".join(f"^{r}$" for r in runs)
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.fromiter((len(r) + 2 for r in runs), np.int64, len(runs))
    place = np.arange(len(codes)) - np.repeat(np.cumsum(size) - size, size)
    rolled, keep, out = mix64(codes + _SEED), place > 0, [np.full((place > 0).sum(), _SEED)]
    for n in range(1, len(hashes)):
        previous = np.zeros_like(rolled)
        previous[1:] = rolled[:-1]
        out.append(np.where(place[keep] >= n, previous[keep], np.uint64(0)))
        before = np.zeros_like(codes)
        before[n:] = codes[:-n]
        rolled = mix64(rolled * np.uint64(0x100000001B3) + before + np.uint64(n))
    return out


class LanguageModels:
    """All languages' models, and the rejection limit of each."""

    def __init__(self, names: list[str], models: list[KneserNey], order: int):
        self.names, self.models, self.order = names, models, order
        self.limits = np.full(len(names), np.inf)

    def words(self, words: list[bytes] | np.ndarray) -> np.ndarray:
        """A row per word: the log-probability in each language, then the number of predicted characters."""
        out = np.zeros((len(words), len(self.names) + 1))
        owner: list[int] = []
        runs: list[str] = []
        for k, word in enumerate(words):
            found = letter_runs(word)
            runs += found
            owner += [k] * len(found)
        if runs and self.models:
            hashes, run = grams(runs, self.order)
            contexts = context_hashes(hashes, runs)
            word = np.array(owner)[run]
            for k, model in enumerate(self.models):
                out[:, k] = np.bincount(word, model.score(hashes, contexts), len(words))
        if runs:
            np.add.at(out[:, -1], np.array(owner), np.fromiter((len(r) + 1 for r in runs), float, len(runs)))
        return out


class TextScorer:
    """Rows of LanguageModels.words summed over texts; words are remembered between batches within a bound."""

    def __init__(self, models: LanguageModels):
        self.models, self.index, self.rows = models, WordIndex(), np.zeros((0, len(models.names) + 1))

    def __call__(self, texts: pa.Array) -> np.ndarray:
        words, per_text = split_words(texts, lower=True)
        codes, names = distinct(words)
        if (kept := self.index.make_room()) is not None:
            self.rows = self.rows[kept]
        if new := self.index.unknown(names):
            self.index.add(new)
            self.rows = np.concatenate([self.rows, self.models.words(new)])
        at = self.index.at(names)
        out = np.zeros((len(texts), len(self.models.names) + 1))
        if words:
            rows, owner = self.rows[at[codes]], np.repeat(np.arange(len(texts)), per_text)
            for c in range(rows.shape[1]):
                out[:, c] = np.bincount(owner, rows[:, c], len(texts))
        return out


def sample_per_language(docs: DataFrame, rows: int, most_languages: int) -> tuple[DataFrame, list[str]]:
    """About `rows` rows of each language at most, by a hash of the id, and the languages as they are spelled, sorted."""
    counts = docs.groupBy("lang").agg(F.count("*").alias("n")).limit(most_languages + 1).collect()
    if len(counts) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not counts:
        return docs.select("doc_id", "text", "lang"), []
    shares = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1_000_000, 1_000_000 * rows // r["n"] + 1))])
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_000)) < F.element_at(shares, F.col("lang"))
    return docs.where(draw).select("doc_id", "text", "lang"), sorted(r["lang"] for r in counts)


def fit_language_models(docs: DataFrame, order: int = 4, rows_per_language: int = 3000, most_languages: int = 512, spare: float = 1.3) -> LanguageModels:
    """Models from the rows of docs whose lang isn't null: from about rows_per_language hashed rows of each language.

    N-grams are counted by Spark over that sample; what reaches the driver is bounded by it. Rejection: a
    language's limit is `spare` times the 99th percentile of the cross-entropies (nats a character) of its sample's
    own texts. Repeated rows count each; null ids are drawn by their hash like others; long texts count whole. Without rows there are no
    languages, and everything is `und`. Raises ValueError beyond most_languages languages.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sample, names = sample_per_language(labelled, rows_per_language, most_languages)
    sample = sample.cache()
    try:

        def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                langs = np.array(batch.column(1).to_pylist(), object)
                texts = byte_column(batch.column(0))
                for start, stop in slices(texts):
                    for lang in sorted(set(langs[start:stop])):
                        words, _ = split_words(texts.slice(start, stop - start).filter(pa.array(langs[start:stop] == lang)))
                        codes, own = distinct(words)
                        runs, times = [], []
                        for word, n in zip(own, np.bincount(codes, minlength=len(own)).tolist(), strict=True):
                            found = letter_runs(word)
                            runs += found
                            times += [n] * len(found)
                        if not runs:
                            continue
                        hashes, run = grams(runs, order)
                        contexts = context_hashes(hashes, runs)
                        weight = np.array(times, np.int64)[run]
                        for n in range(1, order + 1):
                            there = hashes[n - 1] != 0
                            keys, first, code = np.unique(hashes[n - 1][there], return_index=True, return_inverse=True)
                            suffix = hashes[n - 2][there][first] if n > 1 else np.zeros(len(keys), np.uint64)
                            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(np.full(len(keys), n)), pa.array(keys.view(np.int64)), pa.array(contexts[n - 1][there][first].view(np.int64)), pa.array(suffix.view(np.int64)), pa.array(np.bincount(code, weight[there]).astype(np.int64))], names=["lang", "n", "gram", "context", "suffix", "times"])

        rows = sample.select("text", "lang").mapInArrow(count, "lang string, n bigint, gram bigint, context bigint, suffix bigint, times bigint")
        table = rows.groupBy("lang", "n", "gram", "context", "suffix").agg(F.sum("times").alias("times")).toPandas()
        letters = max(1, table.loc[table["n"] == 1, "gram"].nunique())
        models = []
        for lang in names:
            own = table[table["lang"] == lang]
            by_order = {n: (g["gram"].to_numpy().view(np.uint64), g["context"].to_numpy().view(np.uint64), g["suffix"].to_numpy().view(np.uint64), g["times"].to_numpy(float)) for n, g in own.groupby("n")}
            models.append(KneserNey(by_order, order, letters))
        found = LanguageModels(names, models, order)
        entropy = sample.select("doc_id", "text").mapInArrow(_scorer(found, "doc_id"), _schema("doc_id", kind))
        limits = entropy.where("lang_pred <> 'und'").groupBy("lang_pred").agg(F.percentile("cross_entropy", 0.99).alias("limit")).collect()
        for row in limits:
            found.limits[names.index(row["lang_pred"])] = spare * row["limit"]
        return found
    finally:
        sample.unpersist()


def _schema(id_col: str, kind: str) -> str:
    return f"`{id_col}` {kind}, lang_pred string, score double, cross_entropy double, rejected boolean"


def _scorer(models: LanguageModels, id_col: str, scorer: TextScorer | None = None):
    def run(batches: Iterator[pa.RecordBatch], scorer: TextScorer | None = scorer) -> Iterator[pa.RecordBatch]:
        scorer = scorer or TextScorer(models)
        names = np.array([*models.names, "und"], object)
        for batch in batches:
            texts = byte_column(batch.column(1))
            for start, stop in slices(texts):
                rows = scorer(texts.slice(start, stop - start))
                chars = rows[:, -1]
                per_char = -rows[:, :-1] / np.maximum(chars, 1)[:, None] if models.names else np.zeros((len(rows), 1))
                best = per_char.argmin(1) if models.names else np.zeros(len(rows), int)
                # a posterior in which a text weighs as 40 independent characters at most
                odds = np.exp((per_char.min(1, keepdims=True) - per_char) * np.minimum(chars, 40)[:, None])
                none = (chars == 0) | (not models.names)
                entropy = per_char.min(1)
                limit = models.limits[best] if models.names else np.zeros(len(rows))
                # short texts scatter more
                rejected = none | (entropy > limit * (1 + 2 / np.sqrt(np.maximum(chars, 1))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, stop - start), pa.array(names[np.where(none, len(names) - 1, best)].tolist(), pa.string()), pa.array(np.where(none, 0.0, 1 / odds.sum(1))), pa.array(entropy), pa.array(rejected)], names=[id_col, "lang_pred", "score", "cross_entropy", "rejected"])

    return run


def identify(docs: DataFrame, models: LanguageModels, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: id, lang_pred, score (0 to 1), cross_entropy (nats a character) and rejected.

    A null text and one without a letter are `und` with score 0 and rejected; ties go to the language first in name.
    Whole texts are read; equal rows get equal results; other columns are left out.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text).mapInArrow(_scorer(models, id_col), _schema(id_col, kind))


def keep_identified(docs: DataFrame, models: LanguageModels, text: str = "text") -> DataFrame:
    """The rows of docs that aren't rejected, with all their columns; nothing is shuffled."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _scorer(models, "row", TextScorer(models))
        for batch in batches:
            numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(at)], names=["row", "text"])
            rejected = np.concatenate([part.column(4).to_numpy(zero_copy_only=False) for part in score(iter([numbered]))] or [np.zeros(0, bool)])
            yield batch.filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang")
