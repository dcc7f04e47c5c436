"""Baselines of signals (sig, t, v) composed of window operations; only the splines at their ends are per-signal functions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstack.operators import frames as fr
from rillstack.operators import smoothers

EVERY = (Window.unboundedPreceding, Window.unboundedFollowing)
BEHIND, AHEAD = (Window.unboundedPreceding, 0), (0, Window.unboundedFollowing)


def by_time():
    return Window.partitionBy("sig").orderBy("t")


def length(s: DataFrame) -> int:
    return s.agg(F.max("t") + 1).first()[0] or 0


def own_length() -> Column:
    """Of each signal by itself: its last t and one."""
    return F.max("t").over(Window.partitionBy("sig")) + 1


def mirrored(s: DataFrame, reach: int) -> DataFrame:
    """sig, t, v, n_ (the signal's own length) with `reach` samples more on each side, mirrored with the edges repeated, over and over
    where the signal is shorter."""
    own = s.select("sig", "t", "v", own_length().alias("n_"))
    turns = F.floor(reach / (2 * F.col("n_"))) + 1
    at = F.flatten(F.transform(F.sequence(-turns, turns), lambda k: F.array(2 * k * F.col("n_") + F.col("t"), 2 * k * F.col("n_") - 1 - F.col("t"))))
    return own.select("sig", F.explode(F.filter(at, lambda t: (t >= -reach) & (t < F.col("n_") + reach))).alias("t"), "v", "n_")


def within(padded: DataFrame) -> DataFrame:
    """sig, t, v of the samples that are not padding."""
    return padded.where((F.col("t") >= 0) & (F.col("t") < F.col("n_"))).select("sig", "t", "v")


def gauss_weights(sigma: float) -> list[float]:
    """Normal weights out to four sigma, of sum 1."""
    reach = int(4 * sigma + 0.5)
    raw = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1)]
    return [x / math.fsum(raw) for x in raw]


def gaussian(s: DataFrame, sigma: float, n: int | None = None) -> DataFrame:
    """sig, t, v: mean under normal weights, ends mirrored. Each signal's own length counts; n is not read any more."""
    weights = gauss_weights(sigma)
    reach = len(weights) // 2
    near = F.collect_list("v").over(by_time().rowsBetween(-reach, reach))
    v = F.aggregate(F.zip_with(near, F.array(*map(F.lit, weights)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return within(mirrored(s, reach).withColumn("v", v))


def run_min(s: DataFrame, value: Column, out: str, size: int, n: int, overlap: int | None = None) -> DataFrame:
    """s with `out`: over overlapping tiles, the least of the greater running minima of `value` from both ends of a tile."""
    size = min(size, n)
    tiled = s.withColumn("x_", value).withColumn("o_", F.explode(fr.origins(F.col("t"), n, size, size // 2 if overlap is None else overlap)))
    own = Window.partitionBy("sig", "o_").orderBy("t")
    ends = F.greatest(F.min("x_").over(own.rowsBetween(*BEHIND)), F.min("x_").over(own.rowsBetween(*AHEAD)))
    return tiled.withColumn("x_", ends).groupBy(*s.columns).agg(F.min("x_").alias(out))


def _neg(c: str) -> Column:
    return F.lit(0.0) - F.col(c)


def flat_runmin(s: DataFrame, wide: int = 200, narrow: int = 50) -> DataFrame:
    """sig, t, v: what is over the closing of the signal is clipped between an opening and a closing, and the sum is opened again."""
    n = length(s)
    s = s.select("sig", "t", "v").repartition("sig")
    s = run_min(run_min(s, _neg("v"), "a", narrow, n), _neg("a"), "tu", narrow, n).withColumn("flat", F.col("v") - F.col("tu"))
    s = run_min(run_min(s, F.col("flat"), "b", wide, n), _neg("b"), "c", wide, n)
    s = run_min(run_min(s, _neg("flat"), "d", narrow, n), _neg("d"), "e", narrow, n)
    s = s.withColumn("next", F.col("tu") + F.least(F.greatest("flat", _neg("c")), "e"))
    return run_min(run_min(s, F.col("next"), "g", wide, n), _neg("g"), "h", wide, n).select("sig", "t", _neg("h").alias("v"))


def gradient(c: str) -> Column:
    before, after = F.lag(c).over(by_time()), F.lead(c).over(by_time())
    return F.when(before.isNull(), after - F.col(c)).when(after.isNull(), F.col(c) - before).otherwise((after - before) / 2)


def stable_branch(s: DataFrame, size: int = 50) -> DataFrame:
    """sig, t, v from s (sig, t, a, b): of each overlapping tile the branch with the smaller sum of second gradients; later tiles win."""
    n = length(s)
    overlap = max(2, size // 3)
    for c in ("a", "b"):
        s = s.withColumn(f"{c}1", gradient(c))
    for c in ("a", "b"):
        s = s.withColumn(f"{c}2", F.abs(gradient(f"{c}1")))
    tiled = s.withColumn("o", F.explode(fr.origins(F.col("t"), n, min(size, n), overlap)))
    tile = Window.partitionBy("sig", "o")
    v = F.when(F.round(F.sum("a2").over(tile), 9) <= F.round(F.sum("b2").over(tile), 9), F.col("a")).otherwise(F.col("b"))
    return tiled.withColumn("v", v).groupBy("sig", "t").agg(F.max_by("v", "o").alias("v"))


def rolled(s: DataFrame, baseline, rolls: int = 5) -> DataFrame:
    """sig, t, v: median of the baselines of the signal rolled by steps of its length over `rolls`, each rolled back."""
    n = length(s)
    by = list(range(0, n, max(1, n // rolls)))
    many = s.withColumn("r", F.explode(F.array(*(F.lit(r).cast("long") for r in by))))
    many = many.select(F.struct("sig", "r").alias("sig"), ((F.col("t") + F.col("r")) % n).alias("t"), "v")
    back = baseline(many).select("sig.sig", F.pmod(F.col("t") - F.col("sig.r"), F.lit(n)).alias("t"), "v")
    return back.groupBy("sig", "t").agg(F.expr("percentile(v, 0.5)").alias("v"))


def through_knots(s: DataFrame, knot: Column) -> DataFrame:
    """s with v on straight lines through the samples where `knot` holds and the ends."""
    end = F.lag("t").over(by_time()).isNull() | F.lead("t").over(by_time()).isNull()
    k = s.withColumn("k_", F.when(end | F.coalesce(knot, F.lit(False)), F.struct("t", "v")))
    k = k.withColumn("p_", F.last("k_", True).over(by_time().rowsBetween(*BEHIND))).withColumn("q_", F.first("k_", True).over(by_time().rowsBetween(*AHEAD)))
    line = F.col("p_.v") + (F.col("q_.v") - F.col("p_.v")) * (F.col("t") - F.col("p_.t")) / (F.col("q_.t") - F.col("p_.t"))
    return k.withColumn("v", F.when(F.col("p_.t") == F.col("q_.t"), F.col("p_.v")).otherwise(line)).drop("k_", "p_", "q_")


def filtered_minima(s: DataFrame, line, rank_filter, size: int = 5, smooth: float = 25.0, wide: int = 300, reach: float = 1.5) -> DataFrame:
    """sig, t, v: spline of the lines through those local minima of the smoothed, detrended signal that lie within `reach` noise
    deviations of its flattened running minimum; the trend (sig, k, b of `line`) is added again."""
    n = length(s)
    ns = s.withColumn("d", F.lead("v").over(by_time()) - F.col("v")).groupBy("sig").agg((F.stddev_pop("d") / 2**0.5).alias("ns"))
    g = gaussian(rank_filter(s, by_time(), size, size // 2), size / 2)
    own = g.join(line, "sig").join(ns, "sig").withColumn("trend", F.col("k") * F.col("t") + F.col("b")).withColumn("v", F.col("v") - F.col("trend")).drop("k", "b")
    for t, part in ((0, F.col("t") < 2 * wide), (n - 1, F.col("t") >= n - 2 * wide)):
        q = F.percentile(F.when(part, F.col("v")), F.lit(0.25)).over(Window.partitionBy("sig"))
        own = own.withColumn("q", q).withColumn("v", F.when(F.col("t") == t, F.least("v", "q")).otherwise(F.col("v"))).drop("q")
    own = run_min(own, F.col("v"), "low", wide, n)
    own = run_min(own, _neg("low"), "high", wide // 2, n)
    low = F.signum(F.lead("v").over(by_time()) - F.col("v")) > F.signum(F.col("v") - F.lag("v").over(by_time()))
    lines = through_knots(own.withColumn("near", low & (F.abs(F.col("v") + F.col("high")) <= reach * F.col("ns"))), F.col("near"))
    smoothed = smoothers.per_signal(lines, lambda v: smoothers.l2_spline(v, smooth))
    return smoothed.join(own.select("sig", "t", "trend"), ["sig", "t"]).select("sig", "t", (F.col("v") + F.col("trend")).alias("v"))


def split_events(s: DataFrame, th: float = 0.05, high: float = 0.1, smooth: float = 6.0, least: int = 3) -> DataFrame:
    """sig, t, label: runs over th, cut at minima of the smoothed signal under 0.75 of the run's highest maximum where the run has two
    maxima over `high` or more and each part beside the cut has more than `least` samples."""
    z = smoothers.per_signal(s, lambda v: smoothers.l1_spline(v, smooth)).withColumnRenamed("v", "z")
    a, b = F.signum(F.col("z") - F.lag("z").over(by_time())), F.signum(F.lead("z").over(by_time()) - F.col("z"))
    own = s.join(z, ["sig", "t"]).withColumn("top", F.coalesce((b < a) & (F.col("z") > high), F.lit(False))).withColumn("low", F.coalesce(b > a, F.lit(False))).withColumn("on", F.col("v") > th)
    own = _runs(own, "run")
    run = Window.partitionBy("sig", "run")
    left, right = F.col("t") - F.min("t").over(run), F.max("t").over(run) - F.col("t")
    peak = F.max(F.when(F.col("top"), F.col("z"))).over(run)
    sides = ((left == 0) | (left > least)) & ((right == 0) | (right > least)) & (left + right > least)
    cuts = F.col("low") & (F.count_if(F.col("top")).over(run) > 1) & (F.col("z") < 0.75 * peak) & sides
    parts = own.withColumn("cut", F.coalesce(cuts, F.lit(False))).where(~F.col("cut")).select("sig", "t", F.lit(True).alias("on"))
    return _runs(parts, "label").select("sig", "t", "label")


def _runs(s: DataFrame, out: str) -> DataFrame:
    """The rows where on holds, with the number of their run of neighbouring t."""
    on = s.where("on")
    return on.withColumn("new_", F.when(F.lag("t").over(by_time()) == F.col("t") - 1, 0).otherwise(1)).withColumn(out, F.sum("new_").over(by_time())).drop("new_")
