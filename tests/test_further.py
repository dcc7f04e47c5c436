"""Surrogates, Haar-Fisz, ages, baselines and splitting of events against plain versions on small cases."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from rillstack.operators import baselines, events3d, haar, smoothers, surrogates


def _signals(spark, values):
    return spark.createDataFrame([(sig, t, float(x)) for sig, v in values.items() for t, x in enumerate(v)], "sig string, t long, v double")


def _arrays(df):
    return {k: g.sort_values("t")["v"].to_numpy() for k, g in df.toPandas().groupby("sig")}


def test_haar_fisz_of_lengths_that_are_no_powers_of_two(spark):
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 45, 64):
        v = {"a": rng.poisson(5, n), "b": np.zeros(n)}
        s = _signals(spark, v)
        new = haar.haar_fisz(s)
        back = _arrays(haar.haar_fisz_inverse(new))
        assert all(np.allclose(back[k], v[k], atol=1e-6) for k in v)
    flat = _arrays(haar.haar_fisz(_signals(spark, {"a": rng.poisson(50, 512)})))["a"]
    steps = (flat[::2] - flat[1::2]) / 2**0.5
    assert 0.85 < steps.std() < 1.15  # Poisson noise gets variance one


def test_surrogates_keep_the_values_and_their_places(spark):
    s = _signals(spark, {"a": range(100), "b": range(100, 200)})
    new = _arrays(surrogates.shuffled(s, ["sig"]))
    assert sorted(new["a"]) == list(range(100)) and sorted(new["b"]) == list(range(100, 200)) and list(new["a"]) != list(range(100))
    jit = _arrays(surrogates.jittered(s, ["sig"], {"t": 2.0}))
    assert all(len(x) == 100 for x in jit.values()) and abs(jit["a"] - np.arange(100)).max() < 12 and (jit["a"] != np.arange(100)).any()
    same = _arrays(surrogates.jittered(s, ["sig"], {"t": 2.0}))
    assert all((jit[k] == same[k]).all() for k in jit)


def test_jitter_is_the_sequence_of_swaps(spark):
    n = 60
    s = _signals(spark, {"a": np.arange(n)})
    step = s.select("t", F.round(surrogates.normal("jitter:t", ["sig", "t"]) * 3.0).cast("long").alias("d")).toPandas().set_index("t")["d"]
    v, out = np.arange(n), np.arange(n)
    for i in range(n):
        j = min(max(i + step[i], 0), n - 1)
        out[i], out[j] = v[j], v[i]
    assert (_arrays(surrogates.jittered(s, ["sig"], {"t": 3.0}))["a"] == out).all()


def _run_min(v, size):
    n, out = len(v), np.full(len(v), np.inf)
    for o in [*range(0, n - size, size - size // 2), n - size]:
        x = v[o : o + size]
        out[o : o + size] = np.minimum(out[o : o + size], np.maximum(np.minimum.accumulate(x), np.minimum.accumulate(x[::-1])[::-1]))
    return out


def test_flat_runmin_of_other_lengths(spark):
    v = np.random.default_rng(2).gamma(2, size=431)
    up = lambda x, k: -_run_min(-x, k)
    tu = _run_min(up(v, 50), 50)
    flat = v - tu
    nxt = tu + np.minimum(np.maximum(flat, up(_run_min(flat, 200), 200)), _run_min(up(flat, 50), 50))
    assert np.allclose(_arrays(baselines.flat_runmin(_signals(spark, {"a": v})))["a"], up(_run_min(nxt, 200), 200))


def test_gaussian_and_rolled_of_constant_signals(spark):
    s = _signals(spark, {"a": np.full(57, 3.0)})
    assert np.allclose(_arrays(baselines.gaussian(s, 2.0, 57))["a"], 3)
    assert np.allclose(_arrays(baselines.rolled(s, lambda m: m))["a"], 3)


def test_ages_follow_the_oldest_ancestor(spark):
    # segments by frame: 1 -> 2 -> 3 (joined in frame 3 by a younger one, 5), 6 is alone
    seg = spark.createDataFrame([(0, 1, 1, 0, 5), (1, 2, 2, 5, 5), (2, 3, 3, 6, 4), (1, 5, 5, 0, 1), (3, 4, 4, 4, 0), (2, 6, 6, 0, 0)], "t long, label long, node long, overlap long, next long")
    links = spark.createDataFrame([(1, 2), (2, 3), (5, 3), (3, 4)], "a long, b long")
    rows = {r.label: (r.age, r["class"]) for r in events3d.ages(seg, links, 9).collect()}
    assert rows == {1: (1, 1), 2: (2, 2), 3: (3, 2), 4: (4, 3), 5: (1, 1), 6: (1, 3)}


def _split(v, th=0.05, high=0.1, least=3):
    """t -> label, event by event."""
    z = smoothers.l1_spline(v, 6.0)
    step = np.sign(np.diff(z))
    tops, lows = (np.flatnonzero(c) + 1 for c in (step[1:] < step[:-1], step[1:] > step[:-1]))
    on = v > th
    keep, t = on.copy(), 0
    while t < len(v):
        end = t
        while end < len(v) and on[end]:
            end += 1
        own = [m for m in tops if t <= m < end and z[m] > high]
        for m in (m for m in lows if len(own) > 1 and t <= m < end):
            parts = [n for n in (m - t, end - 1 - m) if n]
            if z[m] < 0.75 * max(z[own]) and min(parts) > least:
                keep[m] = False
        t = end + 1
    first = keep & ~np.concatenate(([False], keep[:-1]))
    return {int(t): int(k) for t, k in zip(np.flatnonzero(keep), np.cumsum(first)[keep])}


def test_split_events(spark):
    rng, t = np.random.default_rng(4), np.arange(400)
    bump = lambda c, w: np.exp(-0.5 * ((t - c) / w) ** 2)
    v = {f"r{k}": sum(rng.uniform(0.2, 1) * bump(rng.uniform(0, 400), rng.uniform(4, 20)) for _ in range(10)) for k in range(6)}
    v |= {"two": bump(60, 16) + bump(140, 16), "near": bump(60, 8) + bump(100, 8), "none": 0.01 * bump(50, 5)}
    own = baselines.split_events(_signals(spark, v)).toPandas()
    rows = {sig: dict(zip(g["t"], g["label"])) for sig, g in own.groupby("sig")}
    assert rows == {sig: r for sig, x in v.items() if (r := _split(x))}
    assert max(rows["two"].values()) == 2 and max(rows["near"].values()) == 1  # the spline does not resolve the near ones
    assert any(len(r) < (v[sig] > 0.05).sum() for sig, r in rows.items() if sig[0] == "r")  # some random event is cut


def test_l1_spline_follows_the_unit_of_sparse_signals():
    v = np.zeros(200)
    v[60:90] = np.sin(np.arange(30) / 30 * np.pi)
    assert np.allclose(smoothers.l1_spline(1000 * v, 2.0), 1000 * smoothers.l1_spline(v, 2.0))


def test_signals_without_rows(spark):
    s = _signals(spark, {})
    assert all(isinstance(df.toPandas(), pd.DataFrame) and df.isEmpty() for df in (haar.haar_fisz(s), surrogates.shuffled(s, ["sig"]), surrogates.jittered(s, ["sig"], {"t": 1.0})))
