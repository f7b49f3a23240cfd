"""Bootstrap of several ratios against plain numpy with the same draw."""

import hashlib

import numpy as np
import pytest

from strandline.operators import resampling as R

RATIOS = {"a": ("x", "n"), "b": ("y", "n"), "c": ("y", "z")}
SCHEMA = "g bigint, x bigint, y bigint, z bigint, n bigint"


def drawn(n, seed=1):
    r = np.random.default_rng(seed)
    return [(int(k), int(r.integers(0, 5)), int(r.integers(0, 9)), int(r.integers(0, 2)), int(r.integers(1, 12))) for k in range(n)]


def all_weights(groups, rounds, seed, buckets):
    """Rounds x groups of the whole draw, in the order of `groups`."""
    digest = {g: hashlib.md5(str(g).encode()).hexdigest() for g in groups}
    own = [sorted((digest[g], g) for g in groups if int(digest[g][:8], 16) % buckets == b) for b in range(buckets)]
    sizes, weights = [len(x) for x in own], {}
    for b, members in enumerate(own):
        for start, w in R.group_weights(R.bucket_draws(sizes, rounds, seed, b), len(members), seed, b):
            weights |= {members[start + k][1]: w[:, k] for k in range(w.shape[1])}
    return np.stack([weights[g] for g in groups], axis=1)


@pytest.mark.parametrize("n, buckets", [(300, 256), (40, 8)])
def test_bounds_equal_plain_numpy(spark, n, buckets):
    rows = drawn(n)
    split = [(g, x // 2, y, z, k) for g, x, y, z, k in rows] + [(g, x - x // 2, 0, 0, 0) for g, x, y, z, k in rows] + [(rows[0][0], None, None, None, None)]
    got = {r["ratio"]: (r["groups"], r["low"], r["high"]) for r in R.bootstrap_ratios(spark.createDataFrame(split, SCHEMA).repartition(5), "g", RATIOS, 200, 3, buckets).collect()}
    w = all_weights([r[0] for r in rows], 200, 3, buckets)
    assert (w.sum(axis=1) == n).all()
    columns = dict(zip("xyzn", np.array([r[1:] for r in rows]).T))
    for name, (h, t) in RATIOS.items():
        v = np.sort((w @ columns[h]) / (w @ columns[t]))
        assert got[name] == (n, v[4], v[194])


def test_the_draw_is_multinomial():
    w = all_weights(list(range(50)), 4000, 9, 16)
    assert abs(w.mean() - 1) < 1e-12 and np.abs(w.mean(axis=0) - 1).max() < 0.08
    assert np.abs(w.var(axis=0) - 49 / 50).max() < 0.15
    assert abs(np.cov(w[:, 3], w[:, 30])[0, 1] + 1 / 50) < 0.06


def test_few_groups(spark):
    df = spark.createDataFrame(drawn(1), SCHEMA)
    assert [tuple(r)[1:] for r in R.bootstrap_ratios(df, "g", {"a": ("x", "n")}, 10, 1).collect()] == [(1, None, None)]
    assert [tuple(r)[1:] for r in R.bootstrap_ratios(df.limit(0), "g", {"a": ("x", "n")}, 10, 1).collect()] == [(0, None, None)]


def test_what_is_shuffled_grows_with_rounds_and_buckets(spark):
    plan = R.bootstrap_ratios(spark.createDataFrame(drawn(500), SCHEMA), "g", RATIOS, 50, 3)._jdf.queryExecution().optimizedPlan().toString()
    assert "Range" not in plan and plan.count("FlatMapGroupsInArrow") == 1
