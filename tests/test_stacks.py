"""Jobs over whole stacks, functions of the user's, regions of masks, density clusters and small clusters against plain computations."""

import numpy as np
import pytest
from test_windowed_svd import array, stack

from rillstack.operators import masks, peaks, points, stacks, steps
from rillstack.operators.decompositions import hard_threshold

T, H, W = 40, 9, 12


@pytest.fixture(scope="module")
def movie(spark):
    r = np.random.default_rng(21)
    a = r.gamma(2.0, 2.0, (T, H, W))
    return a, stack(spark, a).cache()


@pytest.fixture(scope="module")
def mask(spark):
    r = np.random.default_rng(22)
    a = r.random((6, H, W)) < np.array([0.0, 0.1, 0.3, 0.5, 0.7, 1.0])[:, None, None]
    return a, spark.createDataFrame([tuple(map(int, c)) for c in np.argwhere(a)], "t long, y long, x long").repartition(3).cache()


def picture(df, shape=(H, W)):
    out = np.full(shape, np.nan)
    for r in df.collect():
        out[r.y, r.x] = r.v
    return out


def cells(df):
    rows = [(r.t, r.y, r.x) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def regions(a):
    """Cells of each 4-connected region."""
    left, out = {tuple(map(int, c)) for c in np.argwhere(a)}, []
    while left:
        todo, own = [min(left)], set()
        while todo:
            c = todo.pop()
            if c in left:
                left.remove(c)
                own.add(c)
                todo += [(c[0] + p, c[1] + q) for p, q in ((0, 1), (1, 0), (0, -1), (-1, 0))]
        out.append(own)
    return out


@pytest.mark.parametrize("smooth", [0, 5])
def test_function_of_pixels(movie, smooth):
    a, df = movie
    got = array(stacks.pixelwise(df, lambda v: v[::-1] * 2, smooth), a.shape)
    for y in range(H):
        for x in range(W):
            v = a[:, y, x]
            if smooth:
                p = np.pad(v, 2, mode="symmetric")
                v = peaks.gaussian(np.array([np.sort(p[t : t + 5])[1] for t in range(T)]), 5)
            assert np.allclose(got[:, y, x], v[::-1] * 2)


def test_function_of_tiles(movie):
    a, df = movie
    for fn in (lambda x: x.std(0), lambda x: x.max()):
        want, n = np.zeros((H, W)), np.zeros((H, W))
        for y in [*range(0, H - 4, 3), H - 4]:
            for x in [*range(0, W - 4, 3), W - 4]:
                want[y : y + 4, x : x + 4] += fn(a[:, y : y + 4, x : x + 4])
                n[y : y + 4, x : x + 4] += 1
        assert np.allclose(picture(stacks.map_tiles(df, fn, 4, 1)), want / n)


def test_principal_baseline(movie):
    a, df = movie
    smoother = lambda v: np.convolve(np.pad(v, 3, mode="edge"), np.ones(7) / 7, "valid")
    m = a.reshape(T, -1).T
    c = m - m.mean(1, keepdims=True)
    u, s, vh = np.linalg.svd(c.T, full_matrices=False)
    r = int((s >= hard_threshold(s, *c.shape)).sum()) + 1
    want = (np.stack([smoother(p) for p in (u[:, :r] * s[:r]).T], 1) @ vh[:r] + m.mean(1)).reshape(a.shape)
    assert np.allclose(array(stacks.principal_baseline(df, smoother), a.shape), want)
    assert np.allclose(array(stacks.principal_baseline(df, lambda v: v, 40), a.shape), want if r >= 40 else (u[:, :r] * s[:r] @ vh[:r] + m.mean(1)).reshape(a.shape))


def test_enhance_of_an_identity_is_overlap_add(movie):
    from rillstack.operators import frames as fr

    a, df = movie
    assert np.allclose(array(stacks.enhance(df, lambda s: s), a.shape), array(fr.overlap_add(df), a.shape))


def test_default_job_finds_a_planted_event(spark):
    r = np.random.default_rng(23)
    t = np.arange(160)
    a = r.normal(100, 1.0, (160, 12, 12)) + (0.01 * t)[:, None, None]
    a[80:110, 3:8, 4:9] += (40 * np.exp(-np.arange(30) / 12))[:, None, None]
    got = stacks.process(stack(spark, a), tsize=80, smoother=lambda v: steps.savgol_rounds(v, 61)).toPandas()
    assert len(got) == a.size and not got.duplicated(["t", "y", "x"]).any()
    on = got[got.v > 0]
    hit = on[on.t.between(78, 112) & on.y.between(1, 9) & on.x.between(2, 10)]
    assert len(on) > 100 and len(hit) > 0.9 * len(on) and {(c.y, c.x) for c in on.itertuples()} >= {(y, x) for y in range(4, 7) for x in range(5, 8)}
    rest = got[(got.t < 75)]
    assert abs(rest.dfof.mean()) < 0.02 and abs(got.f0.mean() - 100) < 3


def test_regions(spark, mask):
    a, df = mask
    labels = masks.label_frames(df, W).cache()
    r = np.random.default_rng(24)
    seeds = {(t, int(r.integers(H)), int(r.integers(W))) for t in range(6) for _ in range(4)}
    seeded = spark.createDataFrame(sorted(seeds), "t long, y long, x long")
    for n, ratio in ((1, 0.0), (3, 0.0), (3, 0.5)):
        want = set()
        for t in range(6):
            own = sorted(regions(a[t]), key=lambda c: (-len(c), min(y * W + x for y, x in c)))
            want |= {(t, *c) for g in own[:n] if len(g) >= ratio * len(own[0]) for c in g}
        assert cells(stacks.largest_regions(labels, n, ratio)) == want
    for least in (1, 4):
        assert cells(stacks.large_regions(labels, least)) == {(t, *c) for t in range(6) for g in regions(a[t]) if len(g) >= least for c in g}
    for without in (False, True):
        want = {(t, *c) for t in range(6) for g in regions(a[t]) if any((t, *c) in seeds for c in g) != without for c in g}
        assert cells(stacks.regions_with(labels, seeded, without)) == want


@pytest.mark.parametrize(("least", "rounds"), [(1, 1), (3, 2)])
def test_refined_masks(mask, least, rounds):
    a, df = mask
    want = set()
    for t in range(6):
        m = a[t]
        for _ in range(rounds):
            p = np.pad(m, 1, mode="symmetric")
            m = m | (np.lib.stride_tricks.sliding_window_view(p, (3, 3)).sum((2, 3)) >= 5)
            if least > 1:
                keep = np.zeros_like(m)
                for g in regions(m):
                    if len(g) >= least:
                        for c in g:
                            keep[c] = True
                m = keep
        want |= {(t, int(y), int(x)) for y, x in np.argwhere(m)}
    assert cells(stacks.refined(df, H, W, least, rounds)) == want


@pytest.mark.parametrize(("radius", "least"), [(1.0, 3), (2.0, 8), (3.0, 12)])
def test_density_clusters(mask, radius, least):
    a, df = mask
    want, noise = {}, set()
    for t in range(6):
        own = [tuple(map(int, c)) for c in np.argwhere(a[t])]
        near = {c: [d for d in own if (c[0] - d[0]) ** 2 + (c[1] - d[1]) ** 2 <= radius**2] for c in own}
        core = [c for c in own if len(near[c]) >= least]
        label = {}
        for c in core:
            if c not in label:
                todo = [c]
                while todo:
                    d = todo.pop()
                    if d not in label:
                        label[d] = c[0] * W + c[1]
                        todo += [e for e in near[d] if len(near[e]) >= least]
        for c in own:
            found = [label[c]] if c in label else [label[d] for d in near[c] if d in label]
            if found:
                want[t, *c] = min(found)
    assert cells(points.cleaned(df, radius, least)) == set(want)
    got = {(r.t, r.y, r.x): r.label for r in points.density_clusters(df, W, radius, least).collect()}
    assert got == want and noise == set()


def test_small_clusters_join_the_nearest(spark):
    r = np.random.default_rng(25)
    v = r.normal(size=(60, 4))
    label = r.choice([3, 5, 7, 11, 13], 60, p=[0.4, 0.35, 0.15, 0.05, 0.05])
    df = spark.createDataFrame([(i, int(label[i]), v[i].tolist(), "k") for i in range(60)], "id long, label int, v array<double>, n string")
    sizes = {k: (label == k).sum() for k in set(label.tolist())}
    large = sorted(k for k, n in sizes.items() if n >= 8)
    centres = np.array([v[label == k].mean(0) for k in large])
    want = [int(k) if k in large else large[int(np.argmin(((centres - x) ** 2).sum(1)))] for k, x in zip(label.tolist(), v)]
    got = points.correct_small_loads(df, 8)
    assert got.columns == df.columns and [x.label for x in got.orderBy("id").collect()] == want
    assert points.correct_small_loads(df, 100).count() == 60 and points.correct_small_loads(df.limit(0), 3).count() == 0


@pytest.mark.parametrize(("clusters", "reverse"), [(0, False), (0, True), (2, False), (2, True)])
def test_adaptive_frames(movie, clusters, reverse):
    a, df = movie
    want = np.empty_like(a)
    for t in range(T):
        p = np.pad(a[t], 1, mode="symmetric")
        m = np.median(np.lib.stride_tricks.sliding_window_view(p, (3, 3)), (2, 3))
        d = a[t] - m
        out = np.abs(d) > 2 * 1.4826 * np.median(np.abs(d - np.median(d)))
        if clusters:
            kept = np.zeros_like(out)
            for g in regions(out):
                if len(g) >= clusters:
                    for c in g:
                        kept[c] = True
            out = ~kept if reverse else out & ~kept
        elif reverse:
            out = ~out
        want[t] = np.where(out, m, a[t])
    assert np.allclose(array(stacks.adaptive_frames(df, 2.0, 3, clusters, reverse), a.shape), want)


def test_blocks_of_a_volume(movie):
    a, df = movie
    for bins, trim in (({"t": 7, "y": 4, "x": 5}, True), ({"t": 7, "y": 4, "x": 5}, False), ({"t": 8, "y": 3, "x": 3}, True)):
        n = list(bins.values())
        fill = a[-n[0] :].min()
        full = np.pad(a, [(0, -s % k) for s, k in zip(a.shape, n)], constant_values=fill)
        want = full.reshape(full.shape[0] // n[0], n[0], full.shape[1] // n[1], n[1], full.shape[2] // n[2], n[2]).sum((1, 3, 5))
        want = want[:-1] if trim and T % n[0] else want
        assert np.allclose(array(stacks.binned(df, bins, trim=trim), want.shape), want)


def test_stained_area(spark):
    a = np.zeros((3, 20, 30))
    a[:, 2:9, 2:12] = 1
    a[:, 12:18, 5:9] = 1
    a[:, 12:19, 15:29] = 1
    a[:, 5, 20] = 1
    got = {(r.y, r.x) for r in stacks.stained_area(stack(spark, a), 0.5, 2, 2, 10).collect()}
    corners = {(2, 2), (2, 11), (8, 2), (8, 11), (12, 15), (12, 28), (18, 15), (18, 28)}  # an opening with crosses takes them off
    block = lambda y, x: {(i, j) for i in range(*y) for j in range(*x)}
    assert got == {(y, x) for y, x in (block((2, 9), (2, 12)) | block((12, 19), (15, 29))) - corners if 2 <= y < 18 and 2 <= x < 28}
