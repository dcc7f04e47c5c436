"""Smoothers and baselines against plain linear algebra and the conditions that define them."""

import numpy as np
import pytest

from rillstack.operators import smoothers as sm

R = np.random.default_rng(5)
V = np.cumsum(R.normal(size=90)) + 5 * (np.arange(90) % 30 == 7)


def matrix(n, s):
    """Identity plus lambda times squared second differences with reflecting ends."""
    d = np.zeros((n, n))
    for i in range(n):
        d[i, i] -= 2
        for j in (i - 1, i + 1):
            d[i, min(max(j, 0), n - 1)] += 1
    return s**4 * d.T @ d


@pytest.mark.parametrize("s", [0.5, 2.0, 8.0])
def test_l2_spline_solves_its_equations(s):
    assert np.allclose(sm.l2_spline(V, s), np.linalg.solve(np.eye(90) + matrix(90, s), V), atol=1e-8)
    w = R.uniform(0.2, 1, 90)
    assert np.allclose(sm.l2_spline(V, s, w, 3000), np.linalg.solve(np.diag(w) + matrix(90, s), w * V), atol=1e-5)


def test_l1_spline_ignores_outliers():
    clean = np.sin(np.arange(200) / 25)
    hit = clean.copy()
    hit[[20, 60, 61, 130]] += 30
    assert np.abs(sm.l1_spline(hit, 6.0, 200) - clean).max() < 0.3 < np.abs(sm.l2_spline(hit, 6.0) - clean).max()


def test_total_variation_is_optimal():
    weight, u = 1.5, sm.total_variation(V, 1.5, 20_000)
    p = np.cumsum(V - u)[:-1]  # the dual: bounded, and at its bound where u steps
    assert np.abs(p).max() <= weight + 1e-6 and abs((V - u).sum()) < 1e-8
    step = np.diff(u)
    assert np.allclose(p[np.abs(step) > 1e-3], -weight * np.sign(step[np.abs(step) > 1e-3]), atol=1e-2)
    assert np.array_equal(sm.total_variation(V[:1], 1.0), V[:1]) and np.array_equal(sm.total_variation(V, 0), V)


def test_baselines_stay_low():
    base = np.linspace(3, 5, 300)
    events = base + R.normal(0, 0.05, 300)
    for at in (40, 120, 121, 210):
        events[at : at + 8] += 4
    for fn in (lambda v: sm.asymmetric_baseline(v, 25.0, 0.05), lambda v: sm.clipped_baseline(v, 25.0)):
        assert np.abs(fn(events) - base).max() < 0.5


def test_pyramid_adds_up():
    assert np.allclose(sm.scale_pyramid(V, 6).sum(0), V) and sm.scale_pyramid(V, 6).shape == (7, 90)


def test_signals_are_smoothed_one_by_one(spark):
    rows = [(f"s{k}", t, float(V[t] * (k + 1))) for k in range(3) for t in range(90)]
    got = {(r.sig, r.t): r.v for r in sm.per_signal(spark.createDataFrame(rows[::-1], "sig string, t long, v double"), lambda v: sm.l2_spline(v, 2.0)).collect()}
    assert len(got) == 270 and all(abs(got[f"s{k}", t] - (k + 1) * sm.l2_spline(V, 2.0)[t]) < 1e-9 for k in range(3) for t in range(90))
    assert sm.per_signal(spark.createDataFrame([], "sig string, t long, v double"), lambda v: v).count() == 0


def test_reconstruction_of_planted_transients():
    v = R.normal(0, 0.3, 400)
    planted = np.zeros(400, bool)
    for at in (50, 180, 300):
        v[at : at + 20] += 6 * np.exp(-np.arange(20) / 8)
        planted[at : at + 20] = True
    rec = sm.reconstruct(v, planted)
    assert np.abs(rec[~planted & ~np.roll(planted, 3) & ~np.roll(planted, -3)]).max() < 0.5 and np.corrcoef(rec[planted], v[planted])[0, 1] > 0.9
    assert not sm.reconstruct(v, np.arange(400) % 10 < 2).any()
    assert sm.runs_of(np.array([1, 1, 0, 1, 1, 1, 0, 1], bool), 3).tolist() == [False, False, False, True, True, True, False, False]


def test_transient_pipeline(spark):
    """Signals with planted transients over a noisy level: found there, and next to nothing elsewhere."""
    from pyspark.sql import Window

    from rillstack.plans.array_queries import transients

    v = 20 + R.normal(0, 1, 600)
    for at in (100, 333, 480):
        v[at : at + 15] += 30
    s = spark.createDataFrame([("a", t, float(x)) for t, x in enumerate(v)] + [("b", t, 0.0) for t in range(600)], "sig string, t long, v double")
    got = {(r.sig, r.t): r.v for r in transients(s, Window.partitionBy("sig").orderBy("t")).collect()}
    a = np.array([got["a", t] for t in range(600)])
    assert len(got) == 1200 and all(got["b", t] == 0 for t in range(600))
    for at in (100, 333, 480):
        assert a[at + 3 : at + 12].min() > 15
    assert np.median(a) < 3
