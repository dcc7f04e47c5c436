"""Peaks, local polynomials, steps and modes against plain computations and planted cases."""

import numpy as np
import pytest

from rillstack.operators import peaks, smoothers, steps


def table(spark, v):
    return spark.createDataFrame([(k, t, float(x)) for k, s in v.items() for t, x in enumerate(s)], "sig string, t long, v double").repartition(4)


def test_maxima_and_prominences():
    """By walking outwards from each peak."""
    r = np.random.default_rng(0)
    for n in (1, 2, 3, 60, 400):
        v = r.integers(0, 8, n).astype(float)
        tops = []
        i = 1
        while i < n - 1:
            j = i
            while j < n - 1 and v[j + 1] == v[i]:
                j += 1
            if v[i - 1] < v[i] and j < n - 1 and v[j + 1] < v[i]:
                tops.append((i + j) // 2)
            i = j + 1
        at = peaks.maxima(v)
        assert at.tolist() == tops
        prom, left, right = peaks.prominences(v, at)
        for k, p in enumerate(tops):
            a = i = p
            while i >= 0 and v[i] <= v[p]:
                a = i if v[i] < v[a] else a
                i -= 1
            b = i = p
            while i < n and v[i] <= v[p]:
                b = i if v[i] < v[b] else b
                i += 1
            assert (left[k], right[k], prom[k]) == (a, b, v[p] - max(v[a], v[b]))


def test_spacing():
    v = np.array([0, 5, 0, 6, 0, 0, 5, 0, 0, 0, 7, 0.0])
    at = peaks.maxima(v)
    assert peaks.spaced(v, at, 3).tolist() == [3, 6, 10] and peaks.spaced(v, at, 4).tolist() == [3, 10] and peaks.spaced(v, at, 1).tolist() == at.tolist()


def test_described_peaks(spark):
    """Two triangles of known widths, without smoothing; separators; and the derivative of a ramp."""
    t = np.arange(100.0)
    v = np.maximum(0, 10 - np.abs(t - 30)) + 2 * np.maximum(0, 8 - np.abs(t - 70))
    df = table(spark, {"a": v, "b": v[::-1], "flat": np.zeros(100)})
    rows = {(r.sig, r.t): r for r in peaks.describe(df, 0.0, 0.2, None).collect()}
    assert rows.keys() == {("a", 30), ("a", 70), ("b", 29), ("b", 69)}
    x = rows["a", 30]
    assert (x.prominence, x.amp, x.fwhm, x.time_to_half, x.ronset, x.finish) == (10, 10, 10, 25, 22, 38) and x.left_base <= 20 and 40 <= x.right_base <= 62
    assert rows["a", 70].prominence == 16 and rows["a", 70].fwhm == 8 and 20 <= x.gonset < 30 and abs(x.dpeak_amp - 1) < 0.05
    one = peaks.describe(df, 0.0).collect()
    assert {(r.sig, r.t) for r in one} == {("a", 70), ("b", 29)}
    cuts = spark.createDataFrame([("a", 50), ("b", 20)], "sig string, t long")
    assert {(r.sig, r.t) for r in peaks.describe(df, 0.0, separators=cuts).collect()} == {("a", 30), ("a", 70), ("b", 29)}


def test_gaussian_derivative():
    v = np.sin(np.arange(300) / 20)
    assert np.allclose(peaks.gaussian(v, 2.0, 1)[20:-20], np.gradient(peaks.gaussian(v, 2.0))[20:-20], atol=1e-4)


@pytest.mark.parametrize(("size", "order"), [(9, 2), (25, 3), (61, 3)])
def test_local_polynomials(spark, size, order):
    r = np.random.default_rng(4)
    v = {"a": r.normal(size=200), "b": r.normal(size=61)}
    got = {k: np.full(len(s), np.nan) for k, s in v.items()}
    for x in steps.savgol(table(spark, v), size, order).collect():
        assert np.isnan(got[x.sig][x.t])
        got[x.sig][x.t] = x.v
    for k, s in v.items():
        want, half = np.empty(len(s)), size // 2
        for t in range(len(s)):
            o = min(max(t - half, 0), len(s) - size)
            want[t] = np.polyval(np.polyfit(np.arange(size) - half, s[o : o + size], order), t - o - half)
        assert np.allclose(got[k], want) and np.allclose(steps.savgol_1d(s, size, order), want)


def test_rounds_leave_a_planted_baseline():
    r = np.random.default_rng(6)
    t = np.arange(1000)
    base = 10 + 3 * np.sin(t / 150)
    v = base + r.normal(0, 0.3, 1000)
    for at in (200, 500, 801):
        v[at : at + 40] += 9
    for fn in (steps.savgol_rounds, steps.l1_rounds):
        assert np.abs(fn(v) - base)[20:-20].max() < 1.6 and np.median(np.abs(fn(v) - base)) < 0.3


def test_rounds_of_the_plain_form():
    """The loop with the simplest smoother there is."""
    r = np.random.default_rng(8)
    v = np.abs(r.normal(size=50)) * 3
    own = v
    ns = 1.4826 * np.median(np.abs(np.diff(v) - np.median(np.diff(v))))
    for _ in range(10):
        z = np.full(50, own.mean())
        own = np.where(np.abs(v - z) > 1.5 * ns, np.full(50, np.median(own)), v)
    assert np.allclose(steps.rounds_of(v, lambda x: np.full(50, x.mean()), lambda x: np.full(50, np.median(x))), z)


def test_planted_steps(spark):
    r = np.random.default_rng(9)
    v = {f"s{k}": r.normal(0, 0.2, 600) + 5 * (np.arange(600) > 250) - (4 * (np.arange(600) > 430) if k < 2 else 0) for k in range(4)}
    found = {}
    for x in steps.find_jumps(table(spark, v)).collect():
        found.setdefault(x.sig, {})[x.t] = x.height
    for k in range(4):
        own = found[f"s{k}"]
        near = [h for t, h in own.items() if abs(t - 250) <= 2]
        assert near and abs(sum(near) - 5) < 1.5
        assert any(abs(t - 430) <= 2 and h < -2 for t, h in own.items()) == (k < 2)
    at = {x.t: x.n for x in steps.coherent_jumps(table(spark, v), 3.0, 3).collect()}
    assert [abs(t - 250) <= 2 for t in at] == [True]
    two = steps.coherent_jumps(table(spark, v), 3.0, 2).collect()
    assert any(abs(x.t - 430) <= 2 for x in two)
    flat = steps.baseline_with_shifts(v["s0"])
    assert abs(flat[100:200].mean()) < 0.4 and abs(flat[300:400].mean() - 5) < 1


def test_modes(spark):
    r = np.random.default_rng(10)
    v = {"low": np.concatenate((r.normal(0, 1, 6000), r.normal(12, 3, 4000))), "one": r.normal(50, 2, 4000)}
    df = table(spark, v)
    rows = {(x.sig, x.bin): x for x in steps.histogram(df).collect()}
    for k, s in v.items():
        lo, hi = np.percentile(s, (1, 95))
        n, _ = np.histogram(s, 100, range=(lo, hi))
        assert [rows[k, b].n if (k, b) in rows else 0 for b in range(100)] == n.tolist()
        z = smoothers.l2_spline(n / n.sum() * 100 / (hi - lo), 3.0)
        tops = [b for b in peaks.maxima(z) if z[b] >= 0.5 * z.max()]
        for kind, best in (("first", tops[0]), ("highest", max(tops, key=lambda b: z[b]))):
            got = {x.sig: x.mode for x in steps.modes(df, kind=kind).collect()}
            assert abs(got[k] - (lo + (hi - lo) * best / 100)) < 1e-9
    area = {x.sig: x.mode for x in steps.modes(df, kind="max_area", least=0.1).collect()}
    assert abs(area["one"] - 50) < 2
    assert {x.sig for x in steps.bias_modes(df).collect()} == {"low", "one"}
