"""Stratified folds of whole groups, and table digests."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import digests as D
from strandline.operators import folds as G


@pytest.mark.parametrize("seed", range(40))
def test_quotas_keep_all_rules(seed):
    r = np.random.default_rng(seed)
    folds, labels = int(r.integers(2, 5)), int(r.integers(1, 6))
    kinds = np.unique(r.integers(0, 3, (int(r.integers(1, 12)), labels)), axis=0)
    kinds = kinds[kinds.sum(axis=1) > 0] if (kinds.sum(axis=1) > 0).any() else np.ones((1, labels), int)
    groups = r.integers(1, 9, len(kinds))
    holders = (kinds > 0).T.astype(int) @ groups
    if (holders < folds).any():
        with pytest.raises(ValueError):
            G.fold_quotas(kinds, groups, folds)
        return
    try:
        quota = G.fold_quotas(kinds, groups, folds)
    except ValueError as e:
        assert "no assignment" in str(e) and holders.min() < 2 * folds  # only where groups of a label are scarce
        return
    assert (quota.sum(axis=1) == groups).all() and (quota >= 0).all()
    assert (quota.T @ kinds > 0).all()


def rows(seed, n=400):
    r = random.Random(seed)
    return [(g if g else None, r.choice(["a", "b", "c", None]) if r.random() < 0.9 else "d") for g in (r.randint(0, 60) if r.random() < 0.7 else 7 for _ in range(n))]  # group 7 holds a third


def test_folds_are_whole_complete_and_even(spark):
    data = rows(3)
    df = spark.createDataFrame(data, "g int, l string").repartition(5)
    got = G.group_folds(df, "g", "l", 3).collect()
    fold = {r["g"]: r["fold"] for r in got}
    assert len(got) == len(fold) == len({g for g, _ in data}) and set(fold.values()) == {0, 1, 2}
    by = defaultdict(int)
    for g, x in data:
        by[fold[g], x] += 1
    assert all(by[f, x] for f in range(3) for x in ("a", "b", "c", "d", None))
    again = {r["g"]: r["fold"] for r in G.group_folds(df.repartition(2), "g", "l", 3).collect()}
    assert fold == again


def test_a_kind_with_most_groups_is_dealt_evenly(spark):
    df = spark.range(3000).select(F.col("id").alias("g"), F.lit("x").alias("l"))
    sizes = [r["count"] for r in G.group_folds(df, "g", "l", 4).groupBy("fold").count().collect()]
    assert sizes == [750] * 4


def test_too_few_groups_raise(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "g int, l string")
    with pytest.raises(ValueError):
        G.group_folds(df, "g", "l", 2)
    assert G.group_folds(df.limit(0), "g", "l", 2).count() == 0


def test_digest_knows_rows_and_not_order(spark):
    item = D.row_text(["a", "b"])
    digest = lambda data: tuple(D.multiset_digest(spark.createDataFrame(data, "a int, b string"), item).first())
    data = [(1, "x"), (2, None), (None, "y"), (1, "x")]
    assert digest(data) == digest(data[::-1]) and digest(data)[0] == 4
    assert len({digest(d) for d in (data, data[:3], [*data[:3], (1, "z")], [*data, (2, None)], [(1, "x"), (2, ""), (None, "y"), (1, "x")], [])}) == 6
