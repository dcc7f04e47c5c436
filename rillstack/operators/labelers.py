"""Labelers of transients, and the pipeline that takes any of them. A labeler is a function of signals (sig, t, v), in noise deviations, to
the labelled samples (sig, t); committees and jittered labelers are built of labelers.

Scale coefficients are rows (sig, level, t, v); thresholds by scale are a table that is joined to them, and votes over the scales are
counted. Jittered replicas of a signal are signals of their own, so Spark spreads them over tasks, and only counts of labels come back.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillstack.operators import smoothers, surrogates

Labeler = Callable[[DataFrame], DataFrame]

# Thresholds of the coefficients of scales 0 .. 11 with base 1.5, for the L1 and the L2 spline.
L1_THRESHOLDS = (2.26212451, 1.11505896, 0.52321721, 0.51701626, 0.42481402, 0.34870014, 0.29144794, 0.24410656, 0.20409004, 0.16792375, 0.13579082, 0.10770976)
L2_THRESHOLDS = (1.6452271, 0.64617428, 0.41641932, 0.32425908, 0.26115802, 0.21203462, 0.17222229, 0.14062114, 0.11350558, 0.0896438, 0.06936852, 0.05300952)


def scales(s: DataFrame, levels: int = 12, base: float = 1.5, smoother: Callable = smoothers.l2_spline) -> DataFrame:
    """sig, level, t, v: differences of the smooths of rising scale; level `levels` is what is left."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("t")
        rows = smoothers.scale_pyramid(own["v"].to_numpy(float), levels, base, smoother)
        many = len(rows)
        return pd.DataFrame({"sig": np.tile(own["sig"].to_numpy(), many), "level": np.repeat(np.arange(many, dtype=np.int32), len(own)), "t": np.tile(own["t"].to_numpy(), many), "v": rows.ravel()})

    return s.select("sig", "t", "v").groupBy("sig").applyInPandas(run, f"sig {s.schema['sig'].dataType.simpleString()}, level int, t long, v double")


def multiscale(votes: int, start: int = 1, thresholds: tuple[float, ...] = L2_THRESHOLDS, smoother: Callable = smoothers.l2_spline) -> Labeler:
    """Samples whose coefficients reach their scales' thresholds in at least so many scales from `start` on."""

    def label(s: DataFrame) -> DataFrame:
        table = s.sparkSession.createDataFrame([(k, th) for k, th in enumerate(thresholds) if k >= start], "level int, th double")
        high = scales(s, len(thresholds), 1.5, smoother).join(F.broadcast(table), "level").where(F.col("v") >= F.col("th"))
        return high.groupBy("sig", "t").count().where(F.col("count") >= votes).select("sig", "t")

    return label


def multiscale_l1(votes: int = 2, start: int = 1) -> Labeler:
    return multiscale(votes, start, L1_THRESHOLDS, smoothers.l1_spline)


def multiscale_l2(votes: int = 4, start: int = 1) -> Labeler:
    return multiscale(votes, start)


def simple(threshold: float = 1.0, tau: float = 5.0, smoother: Callable = smoothers.l2_spline) -> Labeler:
    """Samples whose smoothed value reaches the threshold."""
    return lambda s: smoothers.per_signal(s, lambda v: smoother(v, tau)).where(F.col("v") >= threshold).select("sig", "t")


def percentile(low: float = 0.025, tau: float = 2.0, smoother: Callable = smoothers.l2_spline) -> Labeler:
    """Samples whose smoothed value reaches mu less the low percentile of the samples at or under mu; mu: the median if it is negative, else 0."""

    def label(s: DataFrame) -> DataFrame:
        mu = F.least(F.expr("percentile(v, 0.5)").over(Window.partitionBy("sig")), F.lit(0.0))
        th = s.withColumn("mu", mu).where("v <= mu").groupBy("sig").agg((F.first("mu") - F.expr(f"percentile(v, {low})")).alias("th"))
        return smoothers.per_signal(s, lambda v: smoother(v, tau)).join(th, "sig").where("v >= th").select("sig", "t")

    return label


def committee(*labelers: Labeler) -> Labeler:
    """Samples that all labelers label."""

    def label(s: DataFrame) -> DataFrame:
        votes = reduce(DataFrame.union, (one(s).select("sig", "t", F.lit(k).alias("who")) for k, one in enumerate(labelers)))
        return votes.groupBy("sig", "t").agg(F.count_distinct("who").alias("n")).where(F.col("n") == len(labelers)).select("sig", "t")

    return label


def jittered(labeler: Labeler, rounds: int = 100, weight: float = 0.85, tau: float = 5.0) -> Labeler:
    """Samples labelled in at least that share of seeded replicas of the signal, whose samples are swapped with others about tau / 2 off."""

    def label(s: DataFrame) -> DataFrame:
        copies = s.select("sig", "t", "v", F.explode(F.sequence(F.lit(0), F.lit(rounds - 1))).alias("r"))
        copies = copies.select(F.concat_ws("|", "r", "sig").alias("sig"), "t", "v")
        found = labeler(surrogates.jittered(copies, ["sig"], {"t": 0.5 * tau}))
        return found.groupBy(F.split("sig", r"\|", 2)[1].alias("sig"), "t").count().where(F.col("count") >= weight * rounds).select("sig", "t")

    return label


def multiscale_both() -> Labeler:
    return committee(multiscale_l1(), multiscale_l2(3, 2))


def multiscale_joint(rounds: int = 100) -> Labeler:
    return committee(multiscale_l1(), multiscale_l2(3, 2), jittered(simple(), rounds))


def median_std(s: DataFrame, th: float = 1.0) -> DataFrame:
    """sig, t, v: samples of the runs over the median in which the lightly smoothed signal reaches th deviations from the median; 0 elsewhere."""
    own, w = Window.partitionBy("sig"), Window.partitionBy("sig").orderBy("t")
    d = s.withColumn("m", F.expr("percentile(v, 0.5)").over(own)).withColumn("sd", F.sqrt(F.avg((F.col("v") - F.col("m")) * (F.col("v") - F.col("m"))).over(own)))
    d = d.join(smoothers.per_signal(s, lambda v: smoothers.median_spline(v, 0.5, 3)).withColumnRenamed("v", "z"), ["sig", "t"])
    on = F.col("v") > F.col("m")
    d = d.withColumn("run", F.sum(F.when(on & ~F.coalesce(F.lag(on).over(w), F.lit(False)), 1).otherwise(0)).over(w))
    seeded = F.max(F.when(on & (F.col("z") >= th * F.col("sd")), 1).otherwise(0)).over(Window.partitionBy("sig", "run"))
    return d.select("sig", "t", F.when(on & (seeded == 1), F.col("v")).otherwise(0.0).alias("v"))


# --- rolling noise


def _upper_medians(v: np.ndarray, size: int) -> np.ndarray:
    """The sample of rank size // 2 of each window from size // 2 before a sample on, ends mirrored."""
    half = size // 2
    return _over_windows(np.pad(v, (half, size - 1 - half), mode="symmetric"), size, lambda x: np.partition(x, half, 1)[:, half])


def _over_windows(v: np.ndarray, size: int, fn: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """fn of all windows of a signal, some millions of samples at a time."""
    w = np.lib.stride_tricks.sliding_window_view(v, size)
    step = max(1, (1 << 22) // size)
    return np.concatenate([fn(w[i : i + step]) for i in range(0, len(w), step)])


def rolling_noise(v: np.ndarray, form: str = "medians", smooth: bool = True, details: bool = False) -> np.ndarray:
    """Standard deviation of the noise around each sample, from windows of a fifth of the signal, by medians of distances. form: `medians`
    (rolling median of distances from the rolling median), `window` (each window's distances from its own median) or `ranks` (as the first,
    with the upper of two middle samples). details: v is what is left of the signal already."""
    d = v if details else v - _upper_medians(v, 20)
    n, hw = len(d), max(1, len(d) // 10)
    median = lambda x: _over_windows(x, 2 * hw, lambda w: np.median(w, 1))
    if form == "medians":
        p = np.pad(d, 2 * hw, mode="reflect")
        out = median(np.abs(p[hw : hw + n + 2 * hw] - median(p)[: n + 2 * hw]))[:n]
    elif form == "window":
        out = _over_windows(np.pad(d, hw, mode="reflect"), 2 * hw, lambda w: np.median(np.abs(w - np.median(w, 1)[:, None]), 1))[:n]
    else:
        p = np.pad(d, hw, mode="reflect")
        out = _upper_medians(np.abs(p - _upper_medians(p, 2 * hw)), 2 * hw)[hw:-hw]
    out = 1.4826 * out
    return smoothers.l2_spline(out, 2 * hw) if smooth else out


# --- the pipeline


def pipeline(s: DataFrame, labeler: Labeler | None = None, smoothed: bool = True, noise: DataFrame | None = None, correct_bias: bool = True, th: float = 1.5, **rec) -> DataFrame:
    """sig, t, v: the signals' transients. What is left of a signal without its bias (the median within th noise deviations of the median)
    is divided by its rolling noise (or `noise`: sig, t, sd), labelled, and put together again from the labelled samples."""
    own = Window.partitionBy("sig")
    if noise is None:
        noise = smoothers.per_signal(s, rolling_noise).withColumnRenamed("v", "sd")
    d = s.join(noise, ["sig", "t"]).withColumn("sd", F.greatest("sd", F.lit(1e-9)))
    if correct_bias:
        d = d.withColumn("near", F.when(F.abs(F.col("v") - F.expr("percentile(v, 0.5)").over(own)) <= th * F.col("sd"), F.col("v")))
        d = d.withColumn("v", F.col("v") - F.coalesce(F.expr("percentile(near, 0.5)").over(own), F.lit(0.0))).drop("near")
    d = d.select("sig", "t", (F.col("v") / F.col("sd")).alias("v"), "sd")
    labels = (labeler or percentile())(d.select("sig", "t", "v")).withColumn("on", F.lit(True))

    def run(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values("t")
        return x.assign(v=smoothers.reconstruct(x["v"].to_numpy(), x["on"].to_numpy(bool), smoothed=smoothed, **rec) * x["sd"].to_numpy())[["sig", "t", "v"]]

    both = d.join(labels, ["sig", "t"], "left").withColumn("on", F.coalesce("on", F.lit(False)))
    return both.groupBy("sig").applyInPandas(run, s.select("sig", "t", "v").schema)


def plain_pipeline(s: DataFrame, tau: float = 1.5, threshold: float = 1.0) -> DataFrame:
    """sig, t, v: the signal where its smooth, in rolling noise deviations, reaches the threshold; its positive bias (the median of the samples
    under 2.5 medians) is taken off before."""
    own = Window.partitionBy("sig")
    d = s.withColumn("low", F.when(F.col("v") < 2.5 * F.expr("percentile(v, 0.5)").over(own), F.col("v")))
    bias = F.coalesce(F.expr("percentile(low, 0.5)").over(own), F.expr("percentile(v, 0.5)").over(own))
    d = d.select("sig", "t", (F.col("v") - F.greatest(bias, F.lit(0.0))).alias("v"))
    noise = smoothers.per_signal(s, rolling_noise).withColumnRenamed("v", "sd")
    vn = d.join(noise, ["sig", "t"]).select("sig", "t", (F.col("v") / F.greatest("sd", F.lit(1e-9))).alias("v"))
    labels = simple(threshold, tau)(vn).withColumn("on", F.lit(True))
    return d.join(labels, ["sig", "t"], "left").select("sig", "t", F.when(F.col("on"), F.col("v")).otherwise(0.0).alias("v"))
