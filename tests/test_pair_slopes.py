"""The median slope over all pairs, in one task and over blocks, against the pairs themselves."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from skylattice.operators import pair_slopes
from skylattice.operators.pair_slopes import inversions, median_pair_slope, median_slope


def by_pairs(x, y):
    i, j = np.triu_indices(len(x), 1)
    keep = x[i] != x[j]
    return float(np.median((y[j] - y[i])[keep] / (x[j] - x[i])[keep]))


def noisy(rng, n, digits=None):
    x = rng.normal(size=n) * 100
    y = 2 * x + rng.normal(size=n) * 30
    return (x, y) if digits is None else (x.round(digits), y.round(digits))


def test_inversions():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50):
        rank, w = rng.integers(0, 20, n), rng.integers(1, 9, n)
        assert inversions(rank, w) == sum(int(w[i] * w[j]) for j in range(n) for i in range(j + 1, n) if rank[i] < rank[j])


@pytest.mark.parametrize("digits", [None, 0, -1])
def test_one_group(digits):
    rng = np.random.default_rng(2)
    x, y = noisy(rng, 1_500, digits)
    points, weights = np.unique(np.c_[x, y], axis=0, return_counts=True)
    assert math.isclose(median_slope(points[:, 0], points[:, 1], weights), by_pairs(x, y), rel_tol=1e-12)


def test_degenerate_groups():
    ones = np.ones(2_000, np.int64)
    x = np.arange(2_000.0)
    assert median_slope(x, 3 * x + 1, ones) == 3.0
    assert median_slope(x, np.zeros(2_000), ones) == 0.0
    assert median_slope(np.ones(2_000), x, ones) is None
    assert median_slope(np.array([1.0]), np.array([1.0]), ones[:1]) is None
    assert math.isclose(median_slope(np.r_[x, 5_000.0], np.r_[-x, 1.0], np.r_[ones * 2**40, 1]), -1.0)


def test_blocks_equal_pairs(spark):
    """Groups of many blocks beside small ones, a NULL key, a hot x, copies, rows that take no part."""
    rng = np.random.default_rng(3)
    parts = {"even": noisy(rng, 900, 0), "few": noisy(rng, 40), None: noisy(rng, 500)}
    hot = noisy(rng, 700)
    hot[0][:400] = 7.0
    parts["hot"] = hot
    rows = [(k, float(a), float(b)) for k, (x, y) in parts.items() for a, b in zip(x, y, strict=True)]
    odd = [("even", None, 1.0), ("even", 1.0, None), ("few", float("nan"), 1.0), ("few", 1.0, float("inf")), ("one_x", 1.0, 2.0), ("one_x", 1.0, 3.0)]
    df = spark.createDataFrame(rows + odd, "g string, q_ref double, q_ours double")
    got = {r.g: r.theil_sen for r in median_pair_slope(df, ("g",), "q_ref", "q_ours", block_rows=300).collect()}
    assert set(got) == set(parts)
    for k, (x, y) in parts.items():
        assert math.isclose(got[k], by_pairs(x, y), rel_tol=1e-9), k
    assert median_pair_slope(df.limit(0), ("g",), "q_ref", "q_ours").collect() == []


def test_large_group_without_keys(spark):
    rng = np.random.default_rng(4)
    x, y = noisy(rng, 40_000)
    df = spark.createDataFrame(pd.DataFrame({"q_ref": x, "q_ours": y}))
    got = median_pair_slope(df, (), "q_ref", "q_ours").first().theil_sen
    assert math.isclose(got, median_slope(x, y, np.ones(len(x), np.int64)), rel_tol=1e-12)


def test_groups_that_fit_a_task_are_not_cut(spark, monkeypatch):
    """40,000 points are solved whole, without a round over the cluster for every bracket; beyond ``task_rows`` they are cut."""
    rng = np.random.default_rng(5)
    x, y = noisy(rng, 40_000)
    df = spark.createDataFrame(pd.DataFrame({"g": "a", "q_ref": x, "q_ours": y}))
    cut = median_pair_slope(df.limit(3_000), (), "q_ref", "q_ours", 1_000, 2_000).first().theil_sen
    assert math.isclose(cut, by_pairs(x[:3_000], y[:3_000]), rel_tol=1e-9)
    monkeypatch.setattr(pair_slopes, "_large_groups", None)
    want = median_slope(x, y, np.ones(len(x), np.int64))
    assert [median_pair_slope(df, keys, "q_ref", "q_ours").first().theil_sen for keys in (("g",), ())] == [want, want]
