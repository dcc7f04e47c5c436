"""Operators on a picture of other sides than the fixtures', against plain computations."""

import random

import numpy as np
import pytest

from rillstack.operators import events3d, frames, masks

T, H, W = 6, 12, 17
CROSS = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]


@pytest.fixture(scope="module")
def movie(spark):
    r = random.Random(4)
    on = {(t, y, x) for t in range(T) for y in range(H) for x in range(W) if r.random() < 0.6} | {(0, H - 1, W - 1), (0, 0, 12), (0, 1, 2)}
    return on, spark.createDataFrame(sorted(on), "t long, y long, x long")


def inside(y, x):
    return 0 <= y < H and 0 <= x < W


def rows(df):
    return {tuple(r) for r in df.select("t", "y", "x").collect()}


def test_morphology(movie):
    on, df = movie
    big = {(t, y + a, x + b) for t, y, x in on for a, b in CROSS if inside(y + a, x + b)}
    small = {(t, y, x) for t, y, x in on if all((t, y + a, x + b) in on for a, b in CROSS)}
    assert rows(masks.dilate(df, H, W)) == big and rows(masks.erode(df, H, W)) == small


def test_labels_in_frames_and_over_time(movie):
    on, df = movie
    own = {c: c[1] * W + c[2] for c in on}
    whole = {c: c[0] * H * W + c[1] * W + c[2] for c in on}
    for labels, steps in ((own, [(0, *s) for s in CROSS]), (whole, [(0, *s) for s in CROSS] + [(1, 0, 0), (-1, 0, 0)])):
        moved = True
        while moved:
            moved = False
            for t, y, x in on:
                least = min(labels.get((t + a, y + b, x + c), 1 << 60) for a, b, c in steps)
                if least < labels[t, y, x]:
                    labels[t, y, x], moved = least, True
    framed = masks.label_frames(df, W)
    assert {(r.t, r.y, r.x): r.label for r in framed.collect()} == own
    assert {(r.t, r.y, r.x): r.event for r in events3d.label_movie(framed, H * W).collect()} == whole


def test_tiles_and_zscore(spark):
    r = np.random.default_rng(2)
    v = np.round(r.gamma(2.0, 5.0, (T * 5, H, W)), 3)
    df = spark.createDataFrame([(t, y, x, float(v[t, y, x])) for t in range(T * 5) for y in range(H) for x in range(W)], "t long, y long, x long, v double")
    assert frames.extent(df) == (T * 5, H, W)
    grid = {n: [*range(0, n - 5, 3), n - 5] for n in (H, W)}
    want = {(y, x, a, b) for y in range(H) for x in range(W) for a in grid[H] for b in grid[W] if a <= y < a + 5 and b <= x < b + 5}
    assert {(c.y, c.x, c.ty, c.tx) for c in frames.tiles(df.where("t = 0 or t = 29"), 5, 2).where("t = 0").collect()} == want
    med = np.median(v, 0)
    mad = 1.4826 * np.median(np.abs(v - med), 0)
    bias = np.array([[np.median(v[:, y, x][np.abs(v[:, y, x] - med[y, x]) <= 3 * mad[y, x]]) for x in range(W)] for y in range(H)])
    z = np.where(mad > 1e-5, (v - bias) / (mad + 1e-5), 0)
    got = np.zeros_like(v)
    for c in frames.zscore(df).collect():
        got[c.t, c.y, c.x] = c.z
    assert np.allclose(got, z)
