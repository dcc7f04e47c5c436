"""Higher-order SVD, dynamic modes and dynamical components against numpy and planted cases."""

import itertools

import numpy as np
import pytest
from test_windowed_svd import array, fade, grid, mad, median, stack

from rillstack.operators import tensors
from rillstack.operators.decompositions import hard_threshold

T, H, W = 60, 13, 11


@pytest.fixture(scope="module")
def movie(spark):
    r = np.random.default_rng(5)
    a = r.normal(0, 0.3, (T, H, W)) + 4 * np.sin(np.arange(T) / 5)[:, None, None] * np.outer(np.hanning(H), np.hanning(W)) + 3
    return a, stack(spark, a).cache()


def svd_rank(m):
    s = np.linalg.svd(m, compute_uv=False)
    return int((s >= hard_threshold(s, *m.shape)).sum()) + 1


def test_hosvd(spark, movie):
    a, df = movie
    for ranks in ((None, None, None), (4, 3, 2)):
        got = tensors.hosvd(df, ranks)
        want = a
        for mode in range(3):
            m = np.moveaxis(a, mode, 0).reshape(a.shape[mode], -1)
            u = np.linalg.svd(m, full_matrices=False)[0][:, : ranks[mode] or svd_rank(m)]
            assert got.factors[mode].shape == u.shape
            want = np.moveaxis(np.tensordot(u @ u.T, want, (1, mode)), 0, mode)
        assert np.allclose(array(tensors.hosvd_inverse(spark, got), a.shape), want, atol=1e-8)


def test_hosvd_of_rank_one_is_exact(spark):
    r = np.random.default_rng(1)
    a = np.einsum("t,y,x->tyx", r.normal(size=30), r.normal(size=6), r.normal(size=7))
    got = tensors.hosvd(stack(spark, a), (1, 1, 1))
    assert got.core.shape == (1, 1, 1) and np.allclose(array(tensors.hosvd_inverse(spark, got), a.shape), a)
    assert np.allclose(np.tensordot(got.factors[0], got.collapsed(), 1), a)


@pytest.mark.parametrize(("tfilter", "sfilter", "percentile"), [(0, 0, 0.0), (3, 3, 20.0)])
def test_windowed_hosvd(movie, tfilter, sfilter, percentile):
    a, df = movie
    tsize, size, tover, over = 25, 6, 10, 3
    out, count = np.zeros(a.shape), np.zeros(a.shape)
    for o in itertools.product(grid(T, tsize, tover), grid(H, size, over), grid(W, size, over)):
        at = tuple(slice(b, b + n) for b, n in zip(o, (tsize, size, size)))
        x = a[at] - a[at].mean(0)
        us = []
        for mode, rank in enumerate((None, 3, 3)):
            m = np.moveaxis(x, mode, 0).reshape(x.shape[mode], -1)
            us.append(np.linalg.svd(m, full_matrices=False)[0][:, : rank or svd_rank(m)])
        core = np.einsum("tyx,ta,yb,xc->abc", x, *us)
        if percentile:
            core = np.where(np.abs(core) >= np.percentile(np.abs(core), percentile), core, 0)
        times, maps = us[0].T, np.einsum("abc,yb,xc->ayx", core, us[1], us[2])
        if tfilter:
            times = [np.where(np.abs(v - median(v, 3)) > 3 * mad(v), median(v, 3), v) for v in times]
            maps = [np.where(np.abs(f - median(f, 3)) > 5 * mad(f - median(f, 3)), median(f, 3), f) for f in maps]
        w = fade(tsize, tover)[:, None, None] * np.outer(fade(size, over), fade(size, over))
        out[at] += (np.einsum("at,ayx->tyx", np.array(times), np.array(maps)) + a[at].mean(0)) * w
        count[at] += w
    got = tensors.hosvd_denoise(df, tsize, size, tover, over, tfilter=tfilter, sfilter=sfilter, percentile=percentile)
    assert np.allclose(array(got, a.shape), out / (count + 1e-12), atol=1e-8)


def test_dynamic_modes_of_a_planted_rotation(spark):
    """A rotation by 0.3 that decays by 0.99 a frame, mixed into 25 pixels."""
    r = np.random.default_rng(2)
    z = 0.99 ** np.arange(80) * np.exp(0.3j * np.arange(80))
    a = (np.stack([z.real, z.imag], 1) @ r.normal(size=(2, 25))).reshape(80, 5, 5)
    got = [complex(m.re, m.im) for m in tensors.dmd(stack(spark, a), 2, 2, 2).where("ty = 0 and tx = 0").collect()]
    assert np.allclose(sorted(got, key=lambda c: c.imag), [0.99 * np.exp(-0.3j), 0.99 * np.exp(0.3j)])
    ahead = array(tensors.dmd_denoise(stack(spark, a), 2, 2, 2), a.shape)
    assert np.allclose(ahead[:-1], a[1:])


def test_dmd_denoise(movie):
    """Against the singular value decomposition of each tile in numpy, with the cut-off last tiles."""
    a, df = movie
    nhood, stride = 3, 2
    out, count = np.zeros(a.shape), np.zeros((H, W))
    sides = [[*range(nhood, n - nhood, stride), n - nhood] for n in (H, W)]
    for r, c in itertools.product(*sides):
        at = (slice(None), slice(r - nhood, r + nhood + 1), slice(c - nhood, c + nhood + 1))
        m = a[at].reshape(T, -1).T
        u, s, vh = np.linalg.svd(m[:, :-1], full_matrices=False)
        k = int((s >= hard_threshold(s, *m[:, :-1].shape)).sum()) + 1
        b = m[:, 1:] @ vh[:k].T / s[:k]
        lam, w = np.linalg.eig(u[:, :k].T @ b)
        phi = b @ w
        out[at] += np.stack([((phi * lam) @ np.linalg.lstsq(phi, x.astype(complex), rcond=None)[0]).real for x in m.T]).reshape(a[at].shape)
        count[at[1:]] += 1
    assert np.allclose(array(tensors.dmd_denoise(df, nhood, stride), a.shape), out / count, atol=1e-6)


def lorenz(n):
    x, out = np.array([1.0, 1.0, 20.0]), []
    for _ in range(n):
        for _ in range(10):
            x = x + 0.001 * np.array([10 * (x[1] - x[0]), x[0] * (28 - x[2]) - x[1], x[0] * x[1] - 8 / 3 * x[2]])
        out.append(x)
    return np.array(out)


def test_dyca_finds_the_linear_part(spark):
    """Of a mixed Lorenz system one equation is linear: its eigenvalue is near 1, and the projection spans what it is made of."""
    r = np.random.default_rng(3)
    z = lorenz(1500)
    v = (z - z.mean(0)) @ r.normal(size=(3, 3))
    df = spark.createDataFrame([(t, v[t].tolist()) for t in range(len(v))], "t long, v array<double>").repartition(6)
    near = {x.t: x.d for x in tensors.gradients(df).collect()}
    assert np.allclose(np.array([near[t] for t in range(len(v))]), np.gradient(v, axis=0))
    values, proj, out = tensors.dyca(df, 1)
    d = np.gradient(v, axis=0)
    c0, c1, c2 = v.T @ v / len(v), d.T @ v / len(v), d.T @ d / len(v)
    want = np.sort(np.linalg.eigvals(np.linalg.solve(c2, c1 @ np.linalg.inv(c0) @ c1.T)).real)[::-1]
    assert np.allclose(values, want[want <= 1]) and values[0] > 0.99
    values, proj, out = tensors.dyca(df, 2)
    assert proj.shape == (3, 2)
    rows = {x.t: x.v for x in out.collect()}
    got = np.array([rows[t] for t in range(len(v))])
    assert np.allclose(got, v @ proj)
    for k in (0, 1):  # x and y of the system are combinations of the projected ones
        fit = np.linalg.lstsq(np.column_stack((got, np.ones(len(v)))), z[:, k], rcond=None)[0]
        assert np.corrcoef(np.column_stack((got, np.ones(len(v)))) @ fit, z[:, k])[0, 1] > 0.99


def test_dyca_of_singular_products(spark):
    df = spark.createDataFrame([(t, [float(t), 2.0 * t]) for t in range(20)], "t long, v array<double>")
    assert tensors.dyca(df)[2] is None
