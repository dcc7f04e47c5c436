"""Local polynomials, iterated baselines, steps and modes of signals (sig, t, v).

One pass of a local polynomial is sums over window frames. Iterated forms and step searches run over one signal at a time, the unit in
which they are defined; agreement of steps over signals and histograms are rows that Spark counts.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillstack.operators import baselines, peaks, smoothers

def polynomial_weights(size: int, order: int) -> list[list[float]]:
    """Row k: weights of the samples of a window for the value at its place k of the least-squares polynomial through them."""
    x = np.arange(size) - size // 2
    q, _ = np.linalg.qr(np.vander(x / max(1, size // 2), order + 1, increasing=True))
    return (q @ q.T).tolist()


def savgol(s: DataFrame, size: int, order: int = 3) -> DataFrame:
    """sig, t, v: the value at each sample of a polynomial fitted to the odd window around it; the ends lie on those of the first and last
    windows. A signal must have `size` samples at least."""
    half, w = size // 2, baselines.by_time()
    weights = polynomial_weights(size, order)
    dot = lambda line, c: F.aggregate(F.zip_with(c, line, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    near = s.withColumn("c", F.collect_list("v").over(w.rowsBetween(-half, half)))
    middle = near.where(F.size("c") == size).select("sig", "t", dot(F.array(*map(F.lit, weights[half])), F.col("c")).alias("v"))
    n = baselines.own_length()
    ends = near.withColumn("n", n).where((F.col("t") == half) | (F.col("t") == F.col("n") - 1 - half))
    lines = F.array(*(F.array(*map(F.lit, line)) for line in weights))
    fitted = ends.select("sig", "n", (F.col("t") - half).alias("o"), F.posexplode(F.transform(lines, lambda line: dot(line, F.col("c")))).alias("k", "v"))
    first = fitted.where((F.col("o") == 0) & (F.col("k") < half))
    last = fitted.where((F.col("o") == F.col("n") - size) & (F.col("k") > half))
    return middle.union(first.union(last).select("sig", (F.col("o") + F.col("k")).cast("long").alias("t"), "v"))


def odd(n: int) -> int:
    """n, or the number before it if it is even."""
    return int(n) - (int(n) % 2 == 0)


def savgol_1d(v: np.ndarray, size: int, order: int = 3) -> np.ndarray:
    """The same of one signal."""
    half, weights = size // 2, np.array(polynomial_weights(size, order))
    out = np.convolve(v, weights[half][::-1], "same") if len(v) > size else np.empty(len(v))
    out[:half], out[len(v) - half :] = weights[:half] @ v[:size], weights[half + 1 :] @ v[len(v) - size :]
    if len(v) == size:
        out[half] = weights[half] @ v
    return out


def mad(v: np.ndarray) -> float:
    return float(1.4826 * np.median(np.abs(v - np.median(v)))) if len(v) else 0.0


def rounds_of(v: np.ndarray, smooth: Callable, wide: Callable | None = None, rounds: int = 10, th: float = 1.5, noise: float | None = None, above: bool = False) -> np.ndarray:
    """A baseline by rounds: samples further than th noise deviations from the smooth (above: over it at all) are replaced by the wider
    smooth, the others by the signal's own again. Noise: of the steps, unless given."""
    own, ns = v, mad(np.diff(v)) if noise is None else noise
    z = v
    for _ in range(rounds):
        z, w = smooth(own), (wide or smooth)(own)
        own = np.where(v > z if above else np.abs(v - z) > th * ns, w, v)
    return z


def l1_rounds(v: np.ndarray, s: float = 10.0, wide: float = 25.0, **kw) -> np.ndarray:
    return rounds_of(v, lambda x: smoothers.l1_spline(x, s), lambda x: smoothers.l1_spline(x, wide), **kw)


def savgol_rounds(v: np.ndarray, size: int = 99, wide: int | None = None, order: int = 3, after: float = 5.0, **kw) -> np.ndarray:
    """The same with local polynomials; the result is smoothed."""
    size = odd(min(len(v) - 1, size))
    wide = odd(min(wide or 4 * size - 1, len(v) - 1))
    if size <= order:
        return v
    z = rounds_of(v, lambda x: savgol_1d(x, size, order), lambda x: savgol_1d(x, wide, order), **kw)
    return smoothers.l2_spline(z, after) if after > 0 else z


def total_variation_rounds(v: np.ndarray, weight: float, rounds: int = 5) -> np.ndarray:
    for _ in range(rounds):
        v = smoothers.total_variation(v, weight)
    return v


# --- steps


def turns(v: np.ndarray, low: bool = False) -> np.ndarray:
    """Samples where the sign of the differences falls (low: rises)."""
    d = np.sign(np.diff(-v if low else v))
    return np.flatnonzero(d[1:] < d[:-1]) + 1


def jumps(v: np.ndarray, smooth: float = 1.5, top: float = 95.0, nhood: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Steps of a signal and the staircase they make: maxima of the steepness of its total-variation smooth less its trend, in the highest
    percents, that lie next to where that difference changes its sign; a step's height is that of the means on both sides."""
    trend = smoothers.l1_spline(v, 25.0)
    flat = total_variation_rounds(v, mad(v - trend))
    d = flat - trend
    if smooth > 0:
        d = smoothers.l2_spline(d, smooth)
    steep, total = np.abs(np.gradient(d)), np.cumsum(d)
    at = turns(steep)
    at = at[steep[at] >= np.percentile(steep, top)]
    around = np.concatenate((turns(total), turns(total, True)))
    at = np.array([j for j in at if len(around) and np.abs(around - j).min() < 2], np.int64)
    shift = np.zeros(len(v))
    for j in at:
        if 0 < j < len(v) - 1:
            shift[j + 1] = flat[j + 1 : j + 1 + nhood].mean() - flat[max(0, j - nhood) : j].mean()
    return at, np.cumsum(shift)


def find_jumps(s: DataFrame, **kw) -> DataFrame:
    """sig, t, height of the steps that have one."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("t")
        up = np.diff(jumps(x["v"].to_numpy(float), **kw)[1], prepend=0.0)
        at = np.flatnonzero(up)
        return pd.DataFrame({"sig": x["sig"].iloc[0], "t": x["t"].to_numpy()[at] - 1, "height": up[at]})

    return s.groupBy("sig").applyInPandas(run, "sig string, t long, height double")


def coherent_jumps(s: DataFrame, th: float = 1.5, least: int = 2, **kw) -> DataFrame:
    """t, n: moments at which `least` signals have a step of more than th deviations of their differences. Moments that follow each other count
    as one, named by the one with most signals (of equal ones the first)."""
    w = baselines.by_time()
    sd = s.withColumn("d", F.lead("v").over(w) - F.col("v")).groupBy("sig").agg(F.stddev_pop("d").alias("sd"))
    high = find_jumps(s, **kw).join(sd, "sig").where(F.abs("height") > th * F.col("sd"))
    at = high.groupBy("t").agg(F.count("*").alias("n"))  # a row for each moment at most
    order = Window.orderBy("t")
    runs = at.withColumn("run", F.sum(F.when(F.col("t") - F.lag("t").over(order) == 1, 0).otherwise(1)).over(order))
    return runs.groupBy("run").agg(F.min_by("t", F.struct((-F.col("n")).alias("m"), "t")).alias("t"), F.sum("n").alias("n")).where(F.col("n") >= least).select("t", "n")


def baseline_with_shifts(v: np.ndarray) -> np.ndarray:
    """The staircase of the steps, and a local polynomial baseline of what is left without it."""
    shift = jumps(v)[1]
    return savgol_rounds(v - shift, 199, th=1.5) + shift


# --- modes


def _edges(s: DataFrame, low: float, high: float) -> DataFrame:
    return s.groupBy("sig").agg(F.percentile("v", F.lit(low)).alias("lo"), F.percentile("v", F.lit(high)).alias("hi"))


def histogram(s: DataFrame, bins: int = 100, low: float = 0.01, high: float = 0.95) -> DataFrame:
    """sig, bin, n, lo, hi: samples of each signal between its quantiles lo and hi, by bins of equal width (the last one closed)."""
    own = s.join(_edges(s, low, high), "sig").where(F.col("v").between(F.col("lo"), F.col("hi")) & (F.col("hi") > F.col("lo")))
    place = F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("long")
    return own.groupBy("sig", place.alias("bin")).agg(F.count("*").alias("n"), F.first("lo").alias("lo"), F.first("hi").alias("hi"))


def modes(s: DataFrame, bins: int = 100, smooth: float = 3.0, low: float = 0.01, high: float = 0.95, least: float = 0.5, kind: str = "first") -> DataFrame:
    """sig, mode: the lower edge of the bin of the smoothed histogram's first, highest or largest (`max_area`: height times width) peak of at
    least that share of its maximum; without a peak that of the maximum, and where the quantiles are one value this."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(bins)
        n[x["bin"].to_numpy()] = x["n"].to_numpy()
        lo, hi = x["lo"].iloc[0], x["hi"].iloc[0]
        z = smoothers.l2_spline(n / n.sum() * bins / (hi - lo), smooth)
        at = peaks.maxima(z)
        at = at[z[at] >= least * z.max()]
        if not len(at):
            best = int(np.argmax(z))
        elif kind == "first":
            best = at[0]
        elif kind == "highest":
            best = at[np.argmax(z[at])]
        else:
            prom, left, right = peaks.prominences(z, at)
            width = [np.subtract(*peaks.crossings(z, a, b, c, z[a] - p / 2)[::-1]) for a, b, c, p in zip(at, left, right, prom, strict=True)]
            best = at[np.argmax(z[at] * width)]
        return pd.DataFrame({"sig": [x["sig"].iloc[0]], "mode": [lo + (hi - lo) * best / bins]})

    flat = _edges(s, low, high).where("hi <= lo").select("sig", F.col("lo").alias("mode"))
    return histogram(s, bins, low, high).groupBy("sig").applyInPandas(run, "sig string, mode double").union(flat)


def bias_modes(s: DataFrame, th: float = 3.0, **kw) -> DataFrame:
    """sig, mode of the samples under the median and th noise deviations (of the differences, over the root of 2) more."""
    own, w = Window.partitionBy("sig"), baselines.by_time()
    d = s.withColumn("d", F.lead("v").over(w) - F.col("v"))
    d = d.withColumn("c", F.abs(F.col("d") - F.expr("percentile(d, 0.5)").over(own))).withColumn("ns", 1.4826 / 2**0.5 * F.expr("percentile(c, 0.5)").over(own))
    return modes(d.withColumn("m", F.expr("percentile(v, 0.5)").over(own)).where(F.col("v") < F.col("m") + th * F.col("ns")).select("sig", "t", "v"), **kw)
