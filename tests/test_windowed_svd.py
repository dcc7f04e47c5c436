"""SVD in windows of space and time, its second stage, HOSVD, DMD and DyCA against numpy."""

import itertools

import numpy as np
import pytest

from rillstack.operators import windowed_svd as ws
from rillstack.operators.decompositions import hard_threshold

T, H, W = 200, 24, 20
TSIZE, SIZE, TOVER, OVER = 80, 8, 30, 4


def stack(spark, a):
    rows = [(t, y, x, float(a[t, y, x])) for t in range(a.shape[0]) for y in range(a.shape[1]) for x in range(a.shape[2])]
    return spark.createDataFrame(rows, "t long, y long, x long, v double").repartition(7)


def array(df, shape):
    out = np.full(shape, np.nan)
    for r in df.collect():
        assert np.isnan(out[r.t, r.y, r.x])
        out[r.t, r.y, r.x] = r.v
    return out


@pytest.fixture(scope="module")
def movie(spark):
    r = np.random.default_rng(1)
    t = np.arange(T)
    a = r.normal(0, 1, (T, H, W)) + 5
    for k in range(4):
        spot = np.exp(-((np.arange(H)[:, None] - r.integers(H)) ** 2 + (np.arange(W) - r.integers(W)) ** 2) / 18)
        a += 8 * np.exp(-((t - r.integers(T)) % 70) / 9)[:, None, None] * spot
    a[50, 3, 4] += 60
    return a, stack(spark, a).cache()


def grid(n, size, over):
    return [*range(0, n - size, size - over), n - size]


def fade(n, over):
    x, h = np.arange(n) + 0.5, max(1, over) / 2
    return np.clip((1.01 + np.tanh((x - h) / h) * np.tanh((n - x - h) / h)) / 2, 0, 1)


def median(v, size):
    return np.median(np.lib.stride_tricks.sliding_window_view(np.pad(v, size // 2, mode="symmetric"), (size,) * v.ndim), axis=tuple(range(-v.ndim, 0)))


def mad(v):
    return 1.4826 * np.median(np.abs(v - np.median(v)))


def truncated(m, most=100):
    u, s, vh = np.linalg.svd(m, full_matrices=False)
    r = min(most, int((s >= hard_threshold(s, *m.shape)).sum()) + 1)
    return u[:, :r], s[:r], vh[:r]


def plain(a, tsize, filters=True, stages="", hood=100, fade_time=True):
    """The whole computation in numpy, window by window."""
    parts = {}
    for o in itertools.product(grid(T, tsize, TOVER), grid(H, SIZE, OVER), grid(W, SIZE, OVER)):
        p = a[o[0] : o[0] + tsize, o[1] : o[1] + SIZE, o[2] : o[2] + SIZE].reshape(tsize, -1).T
        centre = p.mean(1)
        u, s, vh = truncated(p - centre[:, None])
        sign = np.where(((vh - vh.mean(1, keepdims=True)) ** 3).sum(1) < 0, -1, 1)
        sig, fil = vh * (sign * s**0.5)[:, None], (u * (sign * s**0.5)).T
        if filters:
            sig = np.array([np.where(np.abs(v - median(v, 3)) > 3 * mad(v), median(v, 3), v) for v in sig])
            sq = [f.reshape(SIZE, SIZE) for f in fil]
            fil = np.array([np.where(np.abs(f - median(f, 3)) > 5 * mad(f - median(f, 3)), median(f, 3), f).ravel() for f in sq])
        parts[o] = [sig, fil, centre]
    hoods = list(itertools.product(grid(H, min(hood, H), min(hood, H) // 2), grid(W, min(hood, W), min(hood, W) // 2)))
    touches = lambda e, o, n: o <= e < o + n or o <= e + SIZE < o + n
    for which, name in ((0, "signals"), (1, "filters")):
        if name in stages:
            acc = {o: [0, 1e-7] for o in parts}
            for ts in grid(T, tsize, TOVER):
                for hy, hx in hoods:
                    own = [o for o in parts if o[0] == ts and touches(o[1], hy, min(hood, H)) and touches(o[2], hx, min(hood, W))]
                    m = np.concatenate([parts[o][which] for o in own])
                    u, s, vh = truncated(m)
                    new = (u * s) @ vh
                    at = 0
                    for o in own:
                        n = len(parts[o][which])
                        acc[o] = [acc[o][0] + new[at : at + n], acc[o][1] + 1]
                        at += n
            for o in parts:
                parts[o][which] = acc[o][0] / acc[o][1]
    out, count = np.zeros(a.shape), np.zeros(a.shape)
    tw = fade(tsize, TOVER) if fade_time and tsize < T else np.ones(tsize)
    w = tw[:, None, None] * np.outer(fade(SIZE, OVER), fade(SIZE, OVER))
    for o, (sig, fil, centre) in parts.items():
        at = tuple(slice(b, b + n) for b, n in zip(o, (tsize, SIZE, SIZE)))
        out[at] += (sig.T @ fil + centre).reshape(tsize, SIZE, SIZE) * w
        count[at] += w
    return out / (count + 1e-12)


@pytest.mark.parametrize("fade_time", [True, False])
def test_windows_alone(movie, fade_time):
    a, df = movie
    got = ws.denoise(df, TSIZE, SIZE, TOVER, OVER, stages="", fade_time=fade_time)
    assert np.allclose(array(got, a.shape), plain(a, TSIZE, fade_time=fade_time), atol=1e-6)


def test_whole_recording_without_filters(movie):
    a, df = movie
    got = ws.denoise(df, -1, SIZE, TOVER, OVER, stages="", tfilter=0, sfilter=0)
    assert np.allclose(array(got, a.shape), plain(a, T, filters=False), atol=1e-6)


@pytest.mark.parametrize(("stages", "hood"), [("signals", 100), ("filters", 12), ("signals filters", 12)])
def test_second_stage(movie, stages, hood):
    a, df = movie
    got = array(ws.denoise(df, TSIZE, SIZE, TOVER, OVER, hood=hood, stages=stages), a.shape)
    assert np.allclose(got, plain(a, TSIZE, stages=stages, hood=hood), atol=1e-5)
    clean = np.median(np.abs(got - a))
    assert 0.4 < clean < 0.9  # what went is about the noise


def test_products_of_many_groups(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(900, 5))
    df = spark.createDataFrame([(int(i % 300), x[i].tolist()) for i in range(900)], "k long, c array<double>").repartition(4)
    old, ws.HELD = ws.HELD, 7
    try:
        got = {row.k: np.array(row.g) for row in ws.products(df, ["k"], "c").collect()}
    finally:
        ws.HELD = old
    for k in range(300):
        own = x[k::300]
        assert np.allclose(got[k], np.concatenate(([3], own.sum(0), (own.T @ own).ravel())))
        n, mean, outer = ws.unpack(got[k], True)
        assert n == 3 and np.allclose(outer, (own - mean).T @ (own - mean))
