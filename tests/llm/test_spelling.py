"""Spelling variants against plain computations: pairs of words, near words of any partition, whole results on odd tables."""

import random
import re
import zlib
from collections import Counter

import pytest

from strandline.llm import spelling as P


def near(a, b):
    if len(a) < len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) - len(b) == 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))


def some_words(seed, letters="abé", longest=6, least=0):
    r = random.Random(seed)
    return sorted({"".join(r.choice(letters) for _ in range(r.randint(least, longest))) for _ in range(r.randint(1, 120))})


@pytest.mark.parametrize("seed", range(60))
def test_pairs_are_all_near_ones_once(seed):
    words = some_words(seed, "abé" if seed % 3 else "ab", 6, seed % 2)
    u, v = P.one_edit_pairs(words)
    got = sorted(tuple(sorted(p)) for p in zip(u.tolist(), v.tolist()))
    assert got == [(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if near(words[i], words[j])]


def test_acceptor_is_minimal():
    words = sorted(x + y for x in ("a", "b", "abc") for y in ("ing", "ed", "s"))
    a = P.Acceptor(words)
    rights = set()
    for prefix in {w[:k] for w in words for k in range(len(w) + 1)}:
        rights.add(frozenset(w[len(prefix) :] for w in words if w.startswith(prefix)))
    assert len(a.count) == len(rights) and a.count[a.root] == len(words)


def plain_near(counts):
    found = {}
    for w in counts:
        close = [v for v in counts if v != w and near(w, v)]
        if close:
            best = min(close, key=lambda v: (-counts[v], v))
            found[w] = (len(close), counts[best], best)
    return found


@pytest.mark.parametrize("most_words", [1, 2, 5, 40, 1000])
def test_near_words_of_any_partition(spark, most_words):
    counts = {w: 5 + zlib.crc32(w.encode()) % 7 for w in some_words(7, "abé", 6, 1) + ["c", "ca", "zzzzzz"]}
    vocabulary = spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(3)
    got = {r["word"]: (r["n_near"], r["best_n"], r["best"]) for r in P.near_words(vocabulary, most_words).collect()}
    assert got == plain_near(counts)


def plain_variants(docs):
    counts = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    close = plain_near(counts)
    form = {w: c[2] for w, c in close.items() if c[1] >= 5 * counts[w]}
    rows = []
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        rows.append((w, form.get(w), root, n, close.get(w, (0,))[0], counts.get(form.get(w))))
    return sorted(rows)


ODD = [(k, " ".join(["receive"] * 40 + ["Recieve", "receivé", "recieve."] * 2)) for k in range(20)] + [
    (None, "received " * 9 + "receives÷" * 5), (3, None), (4, ""), (5, "×"), (6, "ÀÉÎÕÜ-ÀÉÎÕÜß " * 6), (6, "ÀÉÎÕÜ-ÀÉÎÕÜß " * 6), (7, "aaaaaa aaaaaaa aaaaaaaa " * 30 + "aaaaaaaaa " * 900), (8, "日本語 " * 10), (9, "y" * 4000),
    (10, ("chainaa " * 5 + "chainab " * 25 + "chainbb " * 125 + "chaincb " * 625 + "chaincbd " * 3125)),
]


def test_variants_equal_plain_ones(spark):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in ODD], "doc_id bigint, text string, word string, n int").repartition(3)
    want = plain_variants(ODD)
    assert sorted(tuple(r) for r in P.spelling_variants(docs, most_words=3).collect()) == want
    assert any(r[1] != r[2] and r[1] for r in want), "no row has a form of a form"


def test_no_words(spark):
    docs = spark.createDataFrame([(1, "few words")], "doc_id bigint, text string")
    assert P.spelling_variants(docs).collect() == [] and P.spelling_variants(docs.limit(0)).collect() == []
