"""Smoothers and baselines of whole signals (sig, t, v). A signal is one group, the unit in which they are defined; Spark deals out
the signals. The smoothing spline is Garcia's penalised least squares by a discrete cosine transform, with lambda = s**4."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def per_signal(signals: DataFrame, fn: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """sig, t, v: fn of each signal's samples in order of t."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("t")
        return own.assign(v=fn(own["v"].to_numpy(float)))[["sig", "t", "v"]]

    return signals.select("sig", "t", "v").groupBy("sig").applyInPandas(run, signals.select("sig", "t", "v").schema)


def _dct(v: np.ndarray) -> np.ndarray:
    """sum of v[t] cos(pi (t + 1/2) k / n), by a real transform of the mirrored signal."""
    n = len(v)
    k = np.arange(n)
    return (np.fft.rfft(np.concatenate((v, v[::-1])))[:n] * np.exp(-0.5j * np.pi * k / n)).real / 2


def _inverse(c: np.ndarray) -> np.ndarray:
    n = len(c)
    full = np.zeros(n + 1, complex)
    full[:n] = 2 * c * np.exp(0.5j * np.pi * np.arange(n) / n)
    return np.fft.irfft(full, 2 * n)[:n]


def gains(n: int, s: float) -> np.ndarray:
    """What the spline leaves of each cosine."""
    return 1 / (1 + s**4 * (2 - 2 * np.cos(np.pi * np.arange(n) / n)) ** 2)


def l2_spline(v: np.ndarray, s: float, weights: np.ndarray | None = None, rounds: int = 60) -> np.ndarray:
    """Least squares with a penalty on second differences; with weights by fixed-point rounds."""
    g = gains(len(v), s)
    if weights is None:
        return _inverse(g * _dct(v))
    z = v
    for _ in range(rounds):
        z = _inverse(g * _dct(weights * (v - z) + z))
    return z


def l1_spline(v: np.ndarray, s: float, rounds: int = 40, mu: float = 1.0) -> np.ndarray:
    """The same penalty with absolute errors, by split Bregman steps: smooth, shrink what is left, add up the errors."""
    far = np.abs(v - np.median(v))
    scale = max(np.median(far), far.mean() / 10) or 1.0  # most samples may be equal
    v, g = v / scale, gains(len(v), s)
    d, b = np.zeros_like(v), np.zeros_like(v)
    for _ in range(rounds):
        z = _inverse(g * _dct(v + d - b))
        e = z - v + b
        d = np.sign(e) * np.maximum(np.abs(e) - 1 / mu, 0)
        b = e - d
    return z * scale


def total_variation(v: np.ndarray, weight: float, rounds: int = 200) -> np.ndarray:
    """argmin of |u - v|**2 / 2 + weight * sum |u[t + 1] - u[t]|, by projected gradients of the dual."""
    p = np.zeros(max(0, len(v) - 1))
    if not len(p) or weight <= 0:
        return v
    div = lambda p: np.diff(np.concatenate(([0.0], p, [0.0])))
    for _ in range(rounds):
        p = np.clip(p + 0.25 * np.diff(v + div(p)), -weight, weight)
    return v + div(p)


def asymmetric_baseline(v: np.ndarray, s: float = 25.0, p: float = 0.01, rounds: int = 20) -> np.ndarray:
    """Asymmetric least squares: samples over the baseline weigh p, others 1 - p."""
    w = np.ones(len(v))
    for _ in range(rounds):
        z = l2_spline(v, s, w)
        new = np.where(v > z, p, 1 - p)
        if np.array_equal(new, w):
            break
        w = new
    return z


def clipped_baseline(v: np.ndarray, s: float = 25.0, th: float = 3.0, rounds: int = 10) -> np.ndarray:
    """What exceeds the smoothed signal by th deviations of the steps is cut down to it, over and over."""
    d = np.diff(v)
    sd = 1.4826 * np.median(np.abs(d - np.median(d)))
    own = v
    for _ in range(rounds):
        z = l1_spline(own, s)
        own = np.where(v - z > th * sd, z, v)
    return z


def scale_pyramid(v: np.ndarray, levels: int, base: float = 1.5, smoother: Callable = l2_spline) -> np.ndarray:
    """Differences of the smooths with s = base**j; the last row is what is left. The rows add up to the signal."""
    rows, rest = [], v
    for j in range(levels):
        smooth = smoother(v, base**j)
        rows.append(rest - smooth)
        rest = smooth
    return np.array([*rows, rest])


def runs_of(on: np.ndarray, least: int) -> np.ndarray:
    """on without its runs of fewer than `least` samples."""
    edge = np.diff(np.concatenate(([0], on.astype(np.int8), [0])))
    first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = last - first >= least
    out = np.zeros(len(on) + 1, np.int64)
    np.add.at(out, first[keep], 1)
    np.add.at(out, last[keep], -1)
    return np.cumsum(out[:-1]) > 0


def median_spline(v: np.ndarray, s: float, size: int = 3) -> np.ndarray:
    """The spline of the running median (mirrored ends, edges repeated)."""
    half = size // 2
    padded = np.concatenate((v[:half][::-1], v, v[len(v) - (size - 1 - half) :][::-1]))
    return l2_spline(np.median(np.lib.stride_tricks.sliding_window_view(padded, size), 1), s)


def reconstruct(v: np.ndarray, on: np.ndarray, s: float = 1.0, least: int = 3, rounds: int = 10, smoothed: bool = True) -> np.ndarray:
    """The transients of v (in noise deviations) that the labels mark: smoothed under a mask that grows by a sample on each side where the
    smooth is over 1.25 times its positive mean, and shrinks where it is under half of it. Not smoothed: the positive samples under the mask."""
    if not runs_of(on, least).any():
        return np.zeros(len(v))
    mask = on.copy()
    rec = median_spline(median_spline(v, s) * (v > 0), s)
    for _ in range(rounds):
        wide = np.concatenate(([False], mask, [False]))
        if (rec > 0).any():
            mean = rec[rec > 0].mean()
            grown, shrunk = wide[:-2] | wide[1:-1] | wide[2:], wide[:-2] & wide[1:-1] & wide[2:]
            mask = np.where(rec > 1.25 * mean, grown, np.where(rec < 0.5 * mean, shrunk, mask))
        rec = np.maximum(median_spline(v * mask, s), 0)
    return rec if smoothed else v * ((rec > 0) & (v > 0) & mask)
