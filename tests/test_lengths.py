"""Signals of other lengths than the fixtures', two lengths in one table, against numpy."""

import numpy as np
import pytest

from rillstack.operators import baselines
from rillstack.plans import array_queries, signal_queries


LENGTHS = {"long": 1000, "odd": 431, "short": 30}


@pytest.fixture(scope="module")
def both(spark):
    r = np.random.default_rng(3)
    v = {k: np.round(r.gamma(1.0, 20.0, n), 3) for k, n in LENGTHS.items()}
    return v, spark.createDataFrame([(k, t, float(x)) for k, s in v.items() for t, x in enumerate(s)], "sig string, t long, v double").repartition(5)


def check(got, v, fn):
    own = {k: np.full(len(s), np.nan) for k, s in v.items()}
    rows = got.collect()
    for r in rows:
        own[r.sig][r.t] = r.v
    assert len(rows) == sum(map(len, v.values()))
    for k, s in v.items():
        assert np.allclose(own[k], fn(s)), k


def rank(s, size, k):
    half = size // 2
    p = np.pad(s, size, mode="symmetric")
    return np.array([np.sort(p[size + t - half : size + t - half + size])[k] for t in range(len(s))])


def mad(x):
    return 1.4826 * np.median(np.abs(x - np.median(x)))


@pytest.mark.parametrize(("size", "k"), [(9, 4), (9, 2), (20, 10), (10, 5), (75, 3)])
def test_rank_filters(both, size, k):
    check(signal_queries.rank_filter(both[1], baselines.by_time(), size, k), both[0], lambda s: rank(s, size, k))


def test_adaptive_filter(both):
    check(signal_queries.adaptive_filter(both[1], baselines.by_time(), 2.0), both[0], lambda s: np.where(np.abs(s - rank(s, 5, 2)) > 2 * mad(s), rank(s, 5, 2), s))


def test_windowed_running_minimum(both):
    def one(s):
        out, n = np.full(len(s), np.inf), len(s)
        for o in [*range(0, n - 50, 25), max(n - 50, 0)]:
            x = s[o : o + 50]
            out[o : o + 50] = np.minimum(out[o : o + 50], np.maximum(np.minimum.accumulate(x), np.minimum.accumulate(x[::-1])[::-1]))
        return out

    check(signal_queries.windowed_running_min(both[1]), both[0], one)


def test_percentile_baseline(both):
    def one(s):
        p = np.concatenate((np.full(12, np.median(s[:10])), s, np.full(12, np.median(s[-10:]))))
        b = np.array([np.sort(p[t : t + 25])[6] for t in range(len(s))])
        d = s - b
        near = d[np.abs(d) <= 3 * (mad(d) if mad(d) > 0 else d.std())]
        return b + (np.median(near) if len(near) > 10 else 0)

    check(signal_queries.percentile_baseline(both[1], baselines.by_time()), both[0], one)


def test_gaussian(both):
    w = np.array(baselines.gauss_weights(2.5))
    check(baselines.gaussian(both[1], 2.5), both[0], lambda s: np.convolve(np.pad(s, len(w) // 2, mode="symmetric"), w, "valid"))


def test_haar_steps_of_odd_lengths(spark):
    s = spark.createDataFrame([("a", t, float(x)) for t, x in enumerate([4, 2, 6, 8, 10])], "sig string, t long, v double")
    got = {(r.level, r.t): r.d for r in array_queries.haar_levels(s, baselines.by_time()).collect()}
    assert got == {(1, 0): 1, (1, 1): -1, (1, 2): 0, (2, 0): -2, (2, 1): 0, (3, 0): -2.5, (4, 0): 0, (5, 0): 7.5}
    step = {r.t: (r.s, r.a, r.b) for r in array_queries.haar_fisz(s, baselines.by_time()).collect()}
    assert step[2] == (10, 10, None) and np.allclose([*step[0], *step[1]], [3, 4, 2, 7, 6, 8])


def test_movies_of_other_lengths(spark):
    """A frame is a stop only where another one follows, whatever the stack's length."""
    from rillstack.plans import mask_queries

    f = spark.range(100 * 30 * 4).selectExpr("id div 120 t", "id div 4 % 30 y", "id % 4 x", "CASE WHEN id div 120 IN (98, 99) AND id % 4 = 0 THEN 9.0D ELSE 0.0D END v")
    rows = {r.t: r for r in mask_queries.op.segment_states(mask_queries.op.label_frames(mask_queries.op.binary_movie(f), 4), f.select("t").distinct(), mask_queries.fr.extent(f)[0] - 1).collect()}
    assert len(rows) == 100 and (rows[98].inits, rows[99].stops, rows[99].carryover) == (1, 0, 1)
