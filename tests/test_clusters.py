"""Merging by least cost and consensus clusters against plain loops over all pairs."""

import numpy as np
import pytest

from rillstack.operators import clusters


def table(spark, v):
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id long, v array<double>").repartition(4)


def plain(u, k):
    """All pairs in every round."""
    groups = [[i] for i in range(len(u))]
    while len(groups) > k:
        best = min(((len(a) * len(b) / (len(a) + len(b)) * ((u[a].mean(0) - u[b].mean(0)) ** 2).sum(), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j))
        groups[best[1]] += groups.pop(best[2])
    return {i: min(g) for g in groups for i in g}


@pytest.mark.parametrize("k", [1, 4, 9, 60])
def test_least_cost_merges(spark, k):
    r = np.random.default_rng(k)
    v = r.normal(size=(60, 6)) + 4 * r.integers(0, 2, (60, 6))
    u = np.linalg.svd(v, full_matrices=False)[0][:, :3]
    assert {x.id: x.label for x in clusters.ward(table(spark, v), k).collect()} == plain(u, k)
    assert {x.id: x.label for x in clusters.ward(table(spark, v), k, 0).collect()} == plain(v, k)


def test_cells_of_many_points(spark):
    """Four far groups stay apart when points share cells."""
    r = np.random.default_rng(1)
    v = r.normal(0, 0.2, (800, 2)) + 10 * np.array([[0, 0], [0, 1], [1, 0], [1, 1]])[np.arange(800) % 4]
    own, ids, n, means = clusters.celled(table(spark, v).withColumnRenamed("v", "p"), 50)
    assert len(ids) <= 50 and n.sum() == 800 and np.allclose((n[:, None] * means).sum(0) / 800, v.mean(0)) and own.count() == 800
    got = {x.id: x.label for x in clusters.ward(table(spark, v), 4, 0, 50).collect()}
    assert all(got[i] == i % 4 for i in range(800))


def test_consensus(spark):
    r = np.random.default_rng(2)
    v = np.concatenate([r.normal(0, 0.3, (20, 2)) + c for c in ((0, 0), (8, 0), (0, 9))])
    labels = np.stack([clusters.k_means(np.ones(60), v, 6, s) for s in range(15)])
    sets = []
    for i in range(60):
        new = {j for j in range(i, 60) if np.mean(labels[:, i] == labels[:, j]) >= 0.6}
        hit = [c for c in sets if len(c & new) >= 2]
        sets = [set().union(new, *hit), *(c for c in sets if c not in hit)] if hit else [*sets, new]
    want = np.zeros(60, int)
    for k, c in enumerate((c for c in sets if len(c) >= 4), 1):
        want[list(c)] = k
    got = {x.id: x.label for x in clusters.consensus(table(spark, v), 3, 15, 0.6, 4, 2).collect()}
    assert [got[i] for i in range(60)] == want.tolist()
    for a in range(3):  # no cluster spans two of the groups
        assert not set(want[20 * a : 20 * a + 20]) & set(want[20 * a + 20 :]) - {0}


def test_no_points(spark):
    assert clusters.consensus(table(spark, np.zeros((0, 2)))).count() == 0
