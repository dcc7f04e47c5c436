"""Peaks of signals (sig, t, v): spacing, prominence by a search for the nearest higher sample, widths by crossings between samples.

The scans are small functions of one signal, the unit in which they are defined; peaks are rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PEAK = "sig string, t long, amp double, prominence double, left_base long, right_base long, fwhm double, time_to_half double, time_to_half_right double, ronset double, finish double, gonset long, dpeak_amp double"


def gaussian(v: np.ndarray, sigma: float, order: int = 0) -> np.ndarray:
    """The signal under normal weights out to four sigma, or its derivative (order 1); ends mirrored."""
    reach = int(4 * sigma + 0.5)
    k = np.arange(-reach, reach + 1)
    w = np.exp(-0.5 * (k / sigma) ** 2)
    w /= w.sum()
    if order:
        w = w * k / sigma**2
    return np.convolve(np.pad(v, reach, mode="symmetric"), w[::-1] if order else w, "valid")[: len(v)] if reach else v


def maxima(v: np.ndarray) -> np.ndarray:
    """Samples higher than what is on both sides; of a flat top the middle one (the left of two)."""
    edge = np.flatnonzero(np.diff(v) != 0)
    first, last = np.concatenate(([0], edge + 1)), np.concatenate((edge, [len(v) - 1]))
    own = v[first]
    top = np.concatenate(([False], (own[1:-1] > own[:-2]) & (own[1:-1] > own[2:]), [False])) if len(own) > 2 else np.zeros(len(own), bool)
    return (first[top] + last[top]) // 2


def spaced(v: np.ndarray, at: np.ndarray, distance: int) -> np.ndarray:
    """Of peaks nearer than `distance` to a higher kept one (of equal ones the later counts as higher) only that stays."""
    keep = np.ones(len(at), bool)
    for k in np.argsort(v[at], kind="stable")[::-1]:
        if keep[k]:
            near = np.abs(at - at[k]) < distance
            near[k] = False
            keep[near] = False
    return at[keep]


def reach(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far each sample is from the nearest higher one on its left (-1: none): a stack of falling samples, each with the place of the
    lowest sample since the one under it. Returns that nearest place and the place of the lowest sample between."""
    higher, low = np.empty(len(v), np.int64), np.empty(len(v), np.int64)
    stack: list[tuple[int, int]] = []  # place of a sample, and of the lowest one up to it since the sample under it
    for i, x in enumerate(v.tolist()):
        lowest = i
        while stack and v[stack[-1][0]] <= x:
            _, under = stack.pop()
            if v[under] < v[lowest]:
                lowest = under
        higher[i], low[i] = stack[-1][0] if stack else -1, lowest
        stack.append((i, lowest))
    return higher, low


def prominences(v: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Height of peaks over the higher of the lowest samples between them and the nearest higher ones (or the ends), and where these are
    (the nearest to the peak of equal ones)."""
    left = reach(v)[1][at]
    right = len(v) - 1 - reach(v[::-1])[1][len(v) - 1 - at]
    return v[at] - np.maximum(v[left], v[right]), left, right


def crossings(v: np.ndarray, at: int, left: int, right: int, height: float) -> tuple[float, float]:
    """Where the flanks of a peak pass a height, between samples, within its bases."""
    i = at
    while i > left and v[i] > height:
        i -= 1
    a = i + (height - v[i]) / (v[i + 1] - v[i]) if v[i] < height else float(i)
    i = at
    while i < right and v[i] > height:
        i += 1
    b = i - (height - v[i]) / (v[i - 1] - v[i]) if v[i] < height else float(i)
    return a, b


def described(v: np.ndarray, smooth: float, onset: float, most: int | None, distance: int, separators: list[int] | None) -> list[tuple]:
    """Rows of PEAK, without sig, of one signal."""
    z = gaussian(v, smooth) if smooth > 0 else v
    d = gaussian(z, smooth / 2 if smooth > 0 else 1.0, 1)
    tops, slopes = spaced(z, maxima(z), distance), spaced(d, maxima(d), distance)
    if not len(tops):
        return []
    if separators is not None:
        ends = [0, *separators, len(v)]
        chosen, steep = [], []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            own = tops[(tops >= a) & (tops < b)]
            if not len(own):
                continue
            peak = own[np.argsort(-z[own], kind="stable")[0]]
            inside = slopes[(slopes >= a) & (slopes < b) & (slopes < peak)]
            inside = inside if len(inside) else slopes[slopes < peak]
            chosen.append(peak)
            steep.append(inside[np.argsort(d[inside], kind="stable")[-1]] if len(inside) else peak - 1)
    else:
        chosen = np.sort(tops[np.argsort(-z[tops], kind="stable")[:most]])
        ends, steep = [-1, *chosen], []
        for a, b in zip(ends[:-1], ends[1:], strict=True):
            own = slopes[(slopes >= a) & (slopes < b)]
            steep.append(own[np.argsort(d[own], kind="stable")[-1]] if len(own) else b - 1)
    prom, left, right = prominences(z, np.array(chosen, np.int64))
    rows = []
    for k, (peak, slope) in enumerate(zip(chosen, steep, strict=True)):
        a, b = crossings(z, peak, left[k], right[k], z[peak] - 0.5 * prom[k])
        c, e = crossings(z, peak, left[k], right[k], z[peak] - (1 - onset) * prom[k])
        rows.append((int(peak), float(z[peak]), float(prom[k]), int(left[k]), int(right[k]), b - a, a, b, c, e, int(slope), float(d[slope])))
    return rows


def describe(s: DataFrame, smooth: float = 1.5, onset: float = 0.15, most: int | None = 1, distance: int = 10, separators: DataFrame | None = None) -> DataFrame:
    """A row for each of the `most` highest peaks of each smoothed signal (None: all; with separators (sig, t): the highest between two of
    them): amplitude, prominence with its bases, width at half of it, times at half and at the onset's share, and the steepest rise before it."""
    own, parted = s.select("sig", "t", "v", F.lit(False).alias("cut")), separators is not None
    if parted:
        own = own.union(separators.select("sig", "t", F.lit(None).cast("double"), F.lit(True)))

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("t")
        cuts = x.loc[x["cut"], "t"].tolist() if parted else None
        rows = described(x.loc[~x["cut"], "v"].to_numpy(float), smooth, onset, most, distance, cuts)
        return pd.DataFrame([(x["sig"].iloc[0], *r) for r in rows], columns=[c.split()[0] for c in PEAK.split(", ")])

    return own.groupBy("sig").applyInPandas(run, PEAK)


def all_peaks(s: DataFrame) -> DataFrame:
    """sig, t, v, prominence, left_base, right_base of every peak of the signals as they are."""

    def run(x: pd.DataFrame) -> pd.DataFrame:
        v = x.sort_values("t")["v"].to_numpy(float)
        at = maxima(v)
        prom, left, right = prominences(v, at)
        return pd.DataFrame({"sig": x["sig"].iloc[0], "t": at, "v": v[at], "prominence": prom, "left_base": left, "right_base": right})

    return s.groupBy("sig").applyInPandas(run, "sig string, t long, v double, prominence double, left_base long, right_base long")
