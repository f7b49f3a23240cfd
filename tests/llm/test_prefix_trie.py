"""The prefix trie against a plain computation, cut into blocks of any size."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from strandline.llm import prefix_trie as T


def plain_paths(rows):
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r[2], r[3]) for r in sorted(v, key=lambda r: (r[0], r[1], hashlib.sha256(f"{len(r[2])}:{r[2]}{r[3]}".encode()).digest()))] for c, v in own.items()}
    found = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (c % 100 if c >= 0 else -(-c % 100))
        found[c] = tuple(own.get(base, [])[:h] + turns[h:])
    return found


def plain_trie(rows):
    paths = plain_paths(rows)
    members = defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    children = defaultdict(int)
    for node in members:
        if node:
            children[node[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for node, who in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += children[node] == 0
            saved[node[:d]] += (len(who) - 1) * (len(node[-1][1]) if node else 0)
    found = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(paths[c]) == len(node))
        found.append((min(who), len(node), min(members[node[:-1]]) if node else None, len(who), children[node], leaves[node], saved[node], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(found, key=repr)


def some_rows(seed, convs=90):
    r = random.Random(seed)
    rows = []
    for _ in range(convs):
        c = r.choice([r.randint(-150, 450), r.randint(0, 20) * 100])
        rows += [(c, k if r.random() < 0.9 else None, r.choice(["user", "bot", None]), r.choice(["a", "bb", "", None, "日本"])) for k in range(r.choice([0, 1, 2, 3, 9]))]
    rows += [(1000 + k, d, "user", "same") for k in range(60) for d in range(7)]  # many copies of one conversation
    rows += [(None, 0, "user", "nobody")]
    return rows


COLUMNS = "conv_id bigint, turn bigint, role string, text string"


@pytest.mark.parametrize("seed, block", [(1, 10_000), (2, 1), (3, 2), (4, 7), (5, 25)])
def test_trie_equals_a_plain_one(spark, seed, block):
    rows = some_rows(seed)
    turns = spark.createDataFrame([(*x, k, "x") for k, x in enumerate(rows)], COLUMNS + ", depth int, path string").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", block)
    try:
        got = sorted((tuple(r) for r in T.prefix_trie(turns).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == plain_trie(rows)


def test_long_and_turnless_conversations(spark):
    rows = [(7, k, "user", f"turn {k}") for k in range(400)] + [(307, k, "user", f"turn {k}") for k in range(400)] + [(402, 0, "user", "x" * 100_000)] + [(c, 0, "user", "only") for c in range(501, 560)]
    turns = spark.createDataFrame(rows, COLUMNS)
    got = sorted((tuple(r) for r in T.prefix_trie(turns).collect()), key=repr)
    assert got == plain_trie(rows)
    assert any(not p for p in plain_paths(rows).values()), "no conversation is without turns"


def test_no_conversations(spark):
    turns = spark.createDataFrame([(None, 1, "user", "x")], COLUMNS)
    assert T.prefix_trie(turns).collect() == [] and T.prefix_trie(turns.limit(0)).collect() == []


def test_nodes_of_different_depth_merge_once():
    forest = T.Forest([[b"a"], [b"a"], [b"a", b"b"], [b"a", b"c"], [b"d"]], [[1], [1], [1, 2], [1, 3], [5]], [4, 6, 2, 9, 1])
    nodes = {(d, first, last): (done, least, kids) for done, d, first, last, least, kids, _, _ in forest.build()}
    assert nodes == {(2, 2, 2): (True, 2, 0), (2, 3, 3): (True, 9, 0), (1, 0, 3): (False, 2, 2), (1, 4, 4): (False, 1, 0), (0, 0, 4): (False, 1, 0)}
