"""Average linkage by blocks and in rounds, against one task and against merging one pair at a time."""

from __future__ import annotations

import numpy as np
import pytest

from skylattice.operators import learning, linkage


def tiles(spark, v, shapes=2):
    return spark.createDataFrame([(i, i % shapes, [float(x) for x in r]) for i, r in enumerate(v)], "tile_id bigint, shape int, v array<double>")


def merged_one_at_a_time(v, names, limit):
    u = v - v.mean(axis=1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    sums, n, members = list(u), [1] * len(u), [[i] for i in names]
    while len(sums) > 1:
        mean = np.array(sums) / np.array(n)[:, None]
        away = 1 - mean @ mean.T
        away[np.tril_indices(len(sums))] = np.inf
        i, j = np.unravel_index(away.argmin(), away.shape)
        if away[i, j] > limit:
            break
        sums[i], n[i], members[i] = sums[i] + sums[j], n[i] + n[j], members[i] + members[j]
        del sums[j], n[j], members[j]
    return {k: min(m) for m in members for k in m}


@pytest.mark.parametrize("block_rows, finish_rows", [(16, 8), (2_048, 4_096)])
def test_rounds_equal_one_merge_at_a_time(spark, block_rows, finish_rows):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(7, 16))[np.arange(160) % 7] + rng.normal(0, 0.8, (160, 16))
    units = linkage.unit_vectors(tiles(spark, v), "tile_id", "v")
    got = {r.node: r.component for r in linkage.average_linkage(units, 0.4, block_rows, finish_rows).collect()}
    want = {}
    for shape in (0, 1):
        want |= merged_one_at_a_time(v[shape::2], list(range(shape, 160, 2)), 0.4)
    assert {i: got.get(i, i) for i in range(160)} == want and 5 < len(set(want.values())) < 120


@pytest.mark.parametrize("finish_rows", [1, 4_096])
def test_equal_distances_go_by_name(spark, finish_rows):
    """Tiles of one direction, apart in length only: all distances are equal up to rounding."""
    rng = np.random.default_rng(5)
    v = rng.normal(size=12) * np.arange(1, 9)[:, None] * 0.37
    units = linkage.unit_vectors(tiles(spark, v, 1), "tile_id", "v")
    got = {r.node: r.component for r in linkage.average_linkage(units, 0.4, 3, finish_rows).collect()}
    assert got == dict.fromkeys(range(8), 0)


def test_many_resembling_tiles_list_no_links(spark):
    """Every tile resembles every other: 8 x 10^6 links a shape, of which none may be a row."""
    rng = np.random.default_rng(6)
    v = rng.normal(size=24) + rng.normal(0, 0.05, (4_000, 24))
    links = linkage._facing(*[linkage._blocks(linkage.unit_vectors(tiles(spark, v, 1), "tile_id", "v"), "shape", "cluster", ["n"], "sum", 500)] * 2, "shape")
    found = links.drop("shape").mapInArrow(linkage._closest_in_blocks(0.4), "cluster bigint, dist double, a bigint, b bigint")
    assert found.count() <= 4_000 * 16
    assert learning.content_clusters(tiles(spark, v, 1)).select("cluster").distinct().collect() == [(0,)]


def test_blocks_meet_without_a_shuffle_of_their_pairs(spark):
    """Copies of a block for each block that it meets would grow with the square of the tiles."""
    v = np.random.default_rng(8).normal(size=(60, 8))
    made = [linkage.materialize(linkage._blocks(linkage.unit_vectors(tiles(spark, v), "tile_id", "v"), "shape", "cluster", ["n"], "sum", rows), "blocks") for rows in (5, 9)]
    pairs = linkage._facing(*made, "shape")
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan
    left, right = (dict(m.groupBy("shape").count().collect()) for m in made)
    assert pairs.count() == sum(left[shape] * right[shape] for shape in left)


def test_sums_in_single_precision_decide_nothing(spark):
    """Distances that differ by 1e-9 are told apart, although single precision cannot."""
    rng = np.random.default_rng(9)
    u = rng.normal(size=(3, 32))
    v = np.concatenate([u, u[:1] + 1e-2 * u[1:2], u[:1] + (1e-2 + 1e-7) * u[1:2], u[:1] + (1e-2 - 1e-7) * u[1:2]])
    blocks = linkage.materialize(linkage._blocks(linkage.unit_vectors(tiles(spark, v, 1), "tile_id", "v"), "shape", "cluster", ["n"], "sum", 100), "blocks")
    rows = linkage._facing(blocks, blocks, "shape").drop("shape").mapInArrow(linkage._closest_in_blocks(0.4), "cluster bigint, dist double, a bigint, b bigint").collect()
    away = 1 - np.corrcoef(v)[0]
    assert away[3] - away[5] > 5e-10 and away[4] - away[3] > 5e-10
    assert [(r.a, r.b) for r in rows if r.cluster == 0] == [(0, 5)]


def test_best_centre(spark):
    rng = np.random.default_rng(7)
    v, u = rng.normal(size=(90, 10)), rng.normal(size=(14, 10))
    v[5] = 1.0  # no variance, no correlation
    u[9] = u[3]
    centres = spark.createDataFrame([(i, i % 2, [float(x) for x in r]) for i, r in enumerate(u)], "cluster bigint, shape int, u array<double>")
    got = {r.tile_id: r for r in linkage.best_centres(tiles(spark, v), centres, 4).collect()}
    for i in range(90):
        own = [c for c in range(i % 2, 14, 2)]
        if i == 5:
            assert got[i].cluster == 1 and got[i].corr is None
            continue
        corr = [np.corrcoef(v[i], u[c])[0, 1] for c in own]
        assert got[i].cluster == own[int(np.argmax(np.round(corr, 12)))] and np.isclose(got[i].corr, max(corr))
