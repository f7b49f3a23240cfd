"""Closures and cycles against plain walks, and the number of rounds that long chains take."""

import random

import pytest

from strandline.operators import graphs as N

EDGES = "parent bigint, child bigint"


def reach(edges, root):
    depth, front = {root: 0}, [root]
    while front:
        front = [c for p in front for a, c in edges if a == p and c not in depth and not depth.update({c: depth[p] + 1})]
    return depth


def components(edges):
    nodes = {x for e in edges for x in e}
    ahead = {n: set(reach(edges, n)) for n in nodes}
    found = {}
    for n in nodes:
        same = {m for m in ahead[n] if n in ahead[m]}
        if len(same) > 1 or (n, n) in edges:
            found[n] = min(same)
    return found


def drawn(seed):
    r = random.Random(seed)
    n = r.choice([8, 20, 40])
    edges = [(r.randrange(n), r.randrange(n)) for _ in range(int(n * r.choice([0.8, 1.1, 1.6])))]
    ring = [(100 + k, 100 + (k + 1) % 5) for k in range(5)] + [(103, 200), (200, 201)]  # a ring with a tail
    return edges + ring + [(300 + k, 301 + k) for k in range(6)] + [edges[0]] * 2


@pytest.mark.parametrize("seed", range(4))
def test_closure_and_cycles_equal_plain_walks(spark, seed):
    edges = drawn(seed)
    df = spark.createDataFrame([*edges, (None, 1), (2, None)], EDGES)
    roots = [0, 3, 102, 302, 999]
    got = {(r["root"], r["node"]): r["depth"] for r in N.closure(df, spark.createDataFrame([(x,) for x in [*roots, 3]], "root bigint")).collect()}
    assert got == {(x, n): d for x in roots for n, d in reach(edges, x).items()}
    assert {r["node"]: r["component"] for r in N.cycle_components(df).collect()} == components(set(edges))


def test_a_chain_of_two_thousand_in_few_rounds(spark, monkeypatch):
    rounds = []
    own = N.written
    monkeypatch.setattr(N, "written", lambda df, name: rounds.append(name) or own(df, name))
    chain = spark.range(1, 2000).selectExpr("id AS parent", "id + 1 AS child")
    got = {r["node"]: r["depth"] for r in N.closure(chain, spark.createDataFrame([(1,), (1500,)], "root bigint")).where("root = 1").collect()}
    assert got == {k: k - 1 for k in range(1, 2001)}
    assert sum(x in ("hung", "frontier") for x in rounds) <= 15
    rounds.clear()
    back = chain.union(spark.createDataFrame([(1800, 1700)], EDGES))
    assert {r["node"]: r["component"] for r in N.cycle_components(back).collect()} == dict.fromkeys(range(1700, 1801), 1700)


def test_dense_core_splits_into_components(spark):
    two = [(a, b) for base in (0, 10) for a in range(base, base + 4) for b in range(base, base + 4) if a != b] + [(3, 10), (2, 11)]
    df = spark.createDataFrame(two, EDGES)
    assert {r["node"]: r["component"] for r in N.cycle_components(df).collect()} == {**dict.fromkeys(range(4), 0), **dict.fromkeys(range(10, 14), 10)}


def test_no_edges(spark):
    none = spark.createDataFrame([], EDGES)
    assert N.cycle_components(none).count() == 0
    assert [tuple(r) for r in N.closure(none, spark.createDataFrame([(5,)], "root bigint")).collect()] == [(5, 5, 0)]


def test_orphans_and_roots(spark):
    nodes = spark.createDataFrame([(1, "a", "a", None, None), (2, None, "a", "s", "x"), (3, None, "b", "s", "x"), (4, None, "a", "s", "y"), (5, None, "a", None, None)], "n bigint, root string, source string, split string, part string")
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (9, 5)], EDGES)
    assert sorted(tuple(r) for r in N.root_violations(nodes, edges, "n", "root", "source", "split", "part").collect()) == [("roots_differ", 3), ("roots_differ", 5), ("split_differs", 4)]
    assert [tuple(r) for r in N.graph_violations(nodes, edges, "n").collect()] == [("orphan_parent", 9)]
