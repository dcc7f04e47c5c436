"""Labelers, committees, jitter, rolling noise and the pipeline against plain loops."""

import numpy as np
import pandas as pd
import pytest

from rillstack.operators import labelers, smoothers, surrogates

LENGTHS = {"a": 300, "b|c": 187}


@pytest.fixture(scope="module")
def both(spark):
    r = np.random.default_rng(11)
    v = {}
    for k, n in LENGTHS.items():
        s = r.normal(0, 1, n)
        for at in r.integers(0, n - 40, 4):
            s[at : at + 40] += 6 * np.exp(-np.arange(40) / 10)
        v[k] = s
    return v, spark.createDataFrame([(k, t, float(x)) for k, s in v.items() for t, x in enumerate(s)], "sig string, t long, v double").repartition(4).cache()


def places(df):
    rows = [(r.sig, r.t) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def samples(df, v):
    out = {k: np.full(len(s), np.nan) for k, s in v.items()}
    for r in df.collect():
        out[r.sig][r.t] = r.v
    return out


def pyramid(v, smoother):
    rest, out = v, []
    for j in range(12):
        z = smoother(v, 1.5**j)
        out.append(rest - z)
        rest = z
    return np.array(out)


def multiscale(v, kind, votes, start):
    smoother, table = (smoothers.l1_spline, labelers.L1_THRESHOLDS) if kind == 1 else (smoothers.l2_spline, labelers.L2_THRESHOLDS)
    return (pyramid(v, smoother)[start:] >= np.array(table)[start:, None]).sum(0) >= votes


def marked(v, fn):
    return {(k, int(t)) for k, s in v.items() for t in np.flatnonzero(fn(s))}


def test_multiscale_labelers(both):
    v, df = both
    l1, l2 = labelers.multiscale_l1(), labelers.multiscale_l2()
    assert places(l1(df)) == marked(v, lambda s: multiscale(s, 1, 2, 1)) != set()
    assert places(l2(df)) == marked(v, lambda s: multiscale(s, 2, 4, 1)) != set()
    assert places(labelers.multiscale_both()(df)) == marked(v, lambda s: multiscale(s, 1, 2, 1) & multiscale(s, 2, 3, 2))


def test_percentile_labeler(both):
    v, df = both

    def one(s):
        mu = min(np.median(s), 0)
        return smoothers.l2_spline(s, 2.0) >= mu - np.percentile(s[s <= mu], 2.5)

    assert places(labelers.percentile()(df)) == marked(v, one)


def test_jittered_labeler(both):
    """Each replica by itself, labelled by a plain loop; with all samples equal, jitter changes nothing."""
    v, df = both
    from pyspark.sql import functions as F

    count = {}
    for r in range(12):
        copy = surrogates.jittered(df.select(F.concat(F.lit(f"{r}|"), "sig").alias("sig"), "t", "v"), ["sig"], {"t": 2.5})
        own = {f"{r}|{k}": s for k, s in v.items()}
        for k, s in samples(copy, own).items():
            for t in np.flatnonzero(smoothers.l2_spline(s, 5.0) >= 1):
                count[k.split("|", 1)[1], int(t)] = count.get((k.split("|", 1)[1], int(t)), 0) + 1
    got = places(labelers.jittered(labelers.simple(), 12)(df))
    assert got == {p for p, n in count.items() if n >= 0.85 * 12} != set()
    flat = df.withColumn("v", F.lit(2.0))
    assert places(labelers.jittered(labelers.simple(), 3)(flat)) == {(k, t) for k, n in LENGTHS.items() for t in range(n)}


def test_rolling_noise():
    r = np.random.default_rng(1)
    for n in (300, 187, 25):
        v = r.normal(size=n)
        p = np.pad(v, 20, mode="symmetric")
        d = v - np.array([np.sort(p[20 + t - 10 : 20 + t + 10])[10] for t in range(n)])
        hw = n // 10
        s = pd.Series(np.pad(d, 2 * hw, mode="reflect"))
        kw = {"window": 2 * hw, "center": True}
        want = 1.4826 * (s - s.rolling(**kw).median()).abs().rolling(**kw).median().to_numpy()[2 * hw : -2 * hw]
        assert np.allclose(labelers.rolling_noise(v, smooth=False), want)
        assert np.allclose(labelers.rolling_noise(v), smoothers.l2_spline(want, 2 * hw))
        p = np.pad(d, hw, mode="reflect")
        want = [1.4826 * np.median(np.abs(p[i : i + 2 * hw] - np.median(p[i : i + 2 * hw]))) for i in range(n)]
        assert np.allclose(labelers.rolling_noise(v, "window", False), want)

        def ranks(x, hw=hw):
            q = np.pad(x, 2 * hw, mode="symmetric")
            return np.array([np.sort(q[2 * hw + t - hw : 2 * hw + t + hw])[hw] for t in range(len(x))])

        assert np.allclose(labelers.rolling_noise(v, "ranks", False), 1.4826 * ranks(np.abs(p - ranks(p)))[hw:-hw])


@pytest.mark.parametrize("smoothed", [True, False])
def test_pipeline(both, smoothed):
    v, df = both
    got = samples(labelers.pipeline(df, labelers.multiscale_l2(), smoothed), v)
    for k, s in v.items():
        ns = labelers.rolling_noise(s)
        vn = (s - np.median(s[np.abs(s - np.median(s)) <= 1.5 * ns])) / ns
        on = multiscale(vn, 2, 4, 1)
        want = smoothers.reconstruct(vn, on, smoothed=smoothed) * ns
        assert np.allclose(got[k], want, atol=1e-9) and got[k].any()
        if not smoothed:
            assert set(np.round(got[k][got[k] > 0], 9)) <= set(np.round(vn * ns, 9))


def test_pipelines_of_silence(both):
    from pyspark.sql import functions as F

    v, df = both
    for fn in (labelers.pipeline, labelers.plain_pipeline):
        assert all(not s.any() for s in samples(fn(df.withColumn("v", F.lit(0.0))), v).values())


def test_plain_pipeline(both):
    v, df = both
    got = samples(labelers.plain_pipeline(df), v)
    for k, s in v.items():
        low = s[s < 2.5 * np.median(s)]
        y = s - max(np.median(low if len(low) else s), 0)
        assert np.allclose(got[k], np.where(smoothers.l2_spline(y / labelers.rolling_noise(s), 1.5) >= 1, y, 0))


def test_median_std(both):
    v, df = both
    got = samples(labelers.median_std(df), v)
    for k, s in v.items():
        m = np.median(s)
        z, on, out = smoothers.median_spline(s, 0.5, 3), s > m, np.zeros(len(s))
        t = 0
        while t < len(s):
            e = t
            while e < len(s) and on[e]:
                e += 1
            if e > t and (z[t:e] >= np.sqrt(((s - m) ** 2).mean())).any():
                out[t:e] = s[t:e]
            t = max(e, t + 1)
        assert np.allclose(got[k], out)
