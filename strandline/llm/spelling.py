"""Spelling variants: a vocabulary, its near words by composition of acceptors, and the word that each variant stands for."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import stage

LETTERS = "[A-Za-zÀ-ÿ]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lower_ascii(text: Column) -> Column:
    return F.when(F.lower(text) != text, F.translate(text, _UPPER, _UPPER.lower())).otherwise(text)


def words_of(docs: DataFrame, drop_every: int = 199, least_letters: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n): runs of letters, A-Z lowered, met least_count times or more. A run whose crc32 with its doc_id is divisible by
    drop_every has lost one letter (0 for none). Null texts have no runs; a null id counts as the empty text."""
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(LETTERS), F.lit(0))).alias("run")).where(F.char_length("run") >= least_letters)
    run = runs.select("doc_id", lower_ascii(F.col("run")).alias("run"))
    if drop_every:
        h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("run")).cast("binary"))
        hashed = run.withColumn("h", h).withColumn("p", (F.col("h") % F.char_length("run")).cast("int"))
        cut = F.concat(F.left("run", F.col("p")), F.substr("run", F.col("p") + 2))
        run = hashed.select(F.when(F.col("h") % drop_every == 0, cut).otherwise(F.col("run")).alias("run"))
    return run.where(F.char_length("run") >= least_letters).groupBy(F.col("run").alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def with_start(vocabulary: DataFrame, most_words: int) -> DataFrame:
    """Adds `depth`: the shortest prefix of a word that at most most_words words share is so long (else the whole word). It is the initial state of the word's part of the acceptor."""
    prefixes = vocabulary.select("word", F.explode(F.sequence(F.lit(1), F.char_length("word"))).alias("d")).withColumn("prefix", F.left("word", F.col("d")))
    common = prefixes.groupBy("prefix").agg(F.count("*").alias("n")).where(F.col("n") > most_words).select("prefix")
    inner = prefixes.join(common, "prefix").groupBy("word").agg(F.max("d").alias("d"))
    found = vocabulary.join(inner, "word", "left")
    return found.select("word", "n", F.least(F.coalesce("d", F.lit(0)) + 1, F.char_length("word")).alias("depth"))


class Acceptor:
    """The minimised acceptor of sorted distinct words, as arrays: state s has the arcs first[s] to first[s + 1], by label.

    count[s] is how many words are accepted from s, and skip[a] how many of them come before those through arc a, so that the sum
    of the skips along a path is the number of its word.
    """

    def __init__(self, words: list[str]):
        register: dict[tuple, int] = {}
        states: list[tuple] = []

        def closed(node: list) -> int:
            """The state equal to an open node [final, [(label, state)]]."""
            key = (node[0], tuple(node[1]))
            if key not in register:
                register[key] = len(states)
                states.append(key)
            return register[key]

        path, before = [[False, []]], ""

        def close_to(depth: int) -> None:
            while len(path) > depth + 1:
                node = closed(path.pop())
                path[-1][1].append((ord(before[len(path) - 1]), node))

        for word in words:
            same = next((k for k, (x, y) in enumerate(zip(word, before)) if x != y), min(len(word), len(before)))
            close_to(same)
            path += [[False, []] for _ in word[same:]]
            path[-1][0] = True
            before = word
        close_to(0)
        self.root = closed(path[0])
        self.final = np.array([s[0] for s in states], bool)
        self.first = np.cumsum([0, *(len(s[1]) for s in states)])
        self.label = np.array([a for s in states for a, _ in s[1]], np.int64)
        self.target = np.array([t for s in states for _, t in s[1]], np.int64)
        self.count, self.skip = np.zeros(len(states), np.int64), np.zeros(len(self.label), np.int64)
        for s, (final, arcs) in enumerate(states):  # targets are closed before what leads to them
            total = int(final)
            for a, (_, t) in enumerate(arcs, self.first[s]):
                self.skip[a] = total
                total += self.count[t]
            self.count[s] = total
        self._keys = np.repeat(np.arange(len(states)), np.diff(self.first)) << 21 | self.label

    def arcs(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All arcs of these states, and the row of the state that each belongs to."""
        n = self.first[states + 1] - self.first[states]
        row = np.repeat(np.arange(len(states)), n)
        return np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + self.first[states][row], row

    def follow(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The arc of each state with that label, or -1."""
        if not len(self._keys):
            return np.full(len(states), -1)
        key = states << 21 | labels
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return np.where(self._keys[at] == key, at, -1)


def one_edit_pairs(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all pairs of sorted distinct words that one replaced or deleted code point makes equal, each pair once.

    The acceptor is composed with the one-edit transducer and with itself. A state of the result is (p, edited, q): before the
    edit p = q, the edit takes two different arcs of p or one arc against none, and from then on both sides take equal labels. Paths go
    on side by side, a label at a time. An edit stands where the words first differ: the label after a deleted one is another.
    """
    a = Acceptor(words)
    at, number = np.array([a.root]), np.zeros(1, np.int64)
    p = q = i = j = ban = np.zeros(0, np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []
    while len(at) or len(p):
        both = a.final[p] & a.final[q]
        found.append((i[both], j[both]))
        arc, row = a.arcs(p)
        other = a.follow(q[row], a.label[arc])
        on = (other >= 0) & (a.label[arc] != ban[row])
        arc, other, row = arc[on], other[on], row[on]
        stepped = a.target[arc], a.target[other], i[row] + a.skip[arc], j[row] + a.skip[other], np.full(len(arc), -1)
        arc, row = a.arcs(at)
        into = number[row] + a.skip[arc]
        n = np.bincount(row, minlength=len(at))
        ends = np.cumsum(n)
        more = ends[row] - np.arange(len(row)) - 1  # later arcs of the same state
        x = np.repeat(np.arange(len(row)), more)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(more) - more, more)
        replaced = a.target[arc[x]], a.target[arc[y]], into[x], into[y], np.full(len(x), -1)
        deleted = a.target[arc], at[row], into, number[row], a.label[arc]
        p, q, i, j, ban = (np.concatenate(z) for z in zip(stepped, replaced, deleted, strict=True))
        at, number = a.target[arc], into
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


_NEAR = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best_n", pa.int64()), ("best", pa.string())])


def _near_in_part(part: pa.Table) -> pa.Table:
    """Near words of one part: how many each word has, and the one of largest n (ties: the smallest)."""
    part = part.sort_by("word")  # by bytes of UTF-8, which is by code points
    words, n, start = part["word"].to_pylist(), part["n"].to_numpy(), part["depth"][0].as_py()
    u, v = one_edit_pairs([w[start:] for w in words])
    mine, near = np.concatenate([u, v]), np.concatenate([v, u])
    order = np.lexsort((near, -n[near], mine))
    mine, near = mine[order], near[order]
    who, first, count = np.unique(mine, return_index=True, return_counts=True)
    best = near[first]
    return pa.table([[words[k] for k in who], count, n[best], [words[k] for k in best]], schema=_NEAR)


def _near_before_parts(placed: DataFrame) -> DataFrame:
    """As _near_in_part, for edits among the letters that lead to a part: those paths of the composition go from two initial states, and their rest is equal on both sides, so they meet by it."""
    i = F.explode(F.sequence(F.lit(0), F.col("depth") - 1)).alias("i")
    edits = placed.select("word", "n", i).withColumn("rest", F.concat(F.left("word", F.col("i")), F.substr("word", F.col("i") + 2)))
    # a group has one word for each letter at place i
    group = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), F.col("word"))))
    groups = edits.groupBy("i", "rest").agg(group.alias("g")).where(F.size("g") > 1).select("g", F.explode("g").alias("w"))
    best = F.when(F.col("w.word") == F.get("g", F.lit(0))["word"], F.get("g", F.lit(1))).otherwise(F.get("g", F.lit(0)))
    replaced = groups.select("w.word", (F.size("g") - 1).cast("bigint").alias("n_near"), (-best["m"]).alias("best_n"), best["word"].alias("best"))
    last_of_run = F.substr("word", F.col("i") + 1, F.lit(1)) != F.substr("word", F.col("i") + 2, F.lit(1))
    shorter = placed.select(F.col("word").alias("short"), F.col("n").alias("short_n"))
    pairs = edits.where(last_of_run).join(shorter, F.col("rest") == F.col("short"))
    one = F.lit(1).cast("bigint").alias("n_near")
    return replaced.unionByName(pairs.select("word", one, F.col("short_n").alias("best_n"), F.col("short").alias("best"))).unionByName(pairs.select(F.col("short").alias("word"), one, F.col("n").alias("best_n"), F.col("word").alias("best")))


def near_words(vocabulary: DataFrame, most_words: int = 1000) -> DataFrame:
    """(word, n_near, best_n, best) of all words of vocabulary (word, n) that have a near one: one code point inserted, deleted or replaced.

    Parts of the acceptor hold most_words words at most, so neither tasks nor frontiers grow with the vocabulary.
    """
    placed = stage(with_start(vocabulary, most_words), "started-words")
    part = F.left("word", F.col("depth"))
    inside = placed.groupBy(part.alias("part")).applyInArrow(_near_in_part, "word string, n_near bigint, best_n bigint, best string")
    each = inside.unionByName(_near_before_parts(placed)).groupBy("word")
    least = F.min(F.struct((-F.col("best_n")).alias("m"), "best"))
    return each.agg(F.sum("n_near").alias("n_near"), least.alias("b")).select("word", "n_near", (-F.col("b.m")).alias("best_n"), "b.best")


def spelling_variants(docs: DataFrame, drop_every: int = 199, least_letters: int = 6, least_count: int = 5, ratio: int = 5, most_words: int = 1000) -> DataFrame:
    """Per word: word, form (its most frequent near word, if ratio times as frequent), root (the last form in a row), n, n_near, form_n.

    Forms grow by `ratio` each, so a row of them is short and its last is found by doubling. Null and empty texts have no words, repeated rows
    count again, ties of n go to the smaller word, a table without words gives none; other columns are ignored.
    """
    vocabulary = stage(words_of(docs, drop_every, least_letters, least_count), "vocabulary")
    chosen = F.col("best_n") >= ratio * F.col("n")
    joined = vocabulary.join(near_words(vocabulary, most_words), "word", "left")
    forms = stage(joined.select("word", F.when(chosen, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(chosen, F.col("best_n")).alias("form_n")), "forms")
    most = forms.agg(F.max("n")).first()[0] or 1
    longest = max(1, math.floor(math.log(max(most / least_count, 1), ratio) + 1e-9) + 1)
    links = forms.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(longest)))):
        ahead = links.select(F.col("word").alias("root"), F.col("root").alias("beyond"))
        links = stage(links.join(ahead, "root", "left").select("word", F.coalesce("beyond", "root").alias("root")), "forms-doubled")
    return forms.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
