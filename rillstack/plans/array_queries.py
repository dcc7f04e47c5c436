"""Further queries over the hourly signals, the frame stack and given tables, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from rillstack.operators import events3d, smoothers
from rillstack.operators import frames as fr
from rillstack.operators import masks as op
from rillstack.plans.mask_queries import _cross, _LABELS, _movie
from rillstack.plans.signal_queries import rank_filter
from rillstack.sources.fixtures import FRAMES_SQL, SIGNALS_SQL, frames, signals, table

QUERIES, ORACLES = {}, {}


def _rounded(df, digits: int = 6):
    return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def _signal(name: str, sql: str | None, build, digits: int = 6) -> None:
    """build: (signals, their window) -> DataFrame; doubles are rounded on both sides."""
    QUERIES[name] = lambda spark, sf_dir: _rounded(build(signals(spark, sf_dir), Window.partitionBy("sig").orderBy("t")), digits)
    if sql:
        ORACLES[name] = f"WITH {SIGNALS_SQL} {sql}"


def _frame(name: str, sql: str | None, build) -> None:
    QUERIES[name] = lambda spark, sf_dir: _rounded(build(frames(spark, sf_dir)))
    if sql:
        ORACLES[name] = f"WITH RECURSIVE {FRAMES_SQL} {sql}"


_AHEAD, _BEHIND = (0, Window.unboundedFollowing), (Window.unboundedPreceding, 0)

# --- windows over signals


def running_envelope(s, w):
    """sig, t, lower, upper: least and greatest so far; the greatest starts with the second sample."""
    second = F.nth_value("v", 2).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return s.select("sig", "t", F.min("v").over(w.rowsBetween(*_BEHIND)).alias("lower"), F.greatest(F.max("v").over(w.rowsBetween(*_BEHIND)), second).alias("upper"))


_signal(
    "running_envelope",
    ", z AS (SELECT sig, v AS z FROM sig WHERE t = 1) SELECT sig, t, round(min(v) OVER w, 6) AS lower, round(greatest(max(v) OVER w, z), 6) AS upper FROM sig JOIN z USING (sig) WINDOW w AS (PARTITION BY sig ORDER BY t)",
    running_envelope,
)


def windowed_envelope(s, w, size: int = 50, overlap: int = 25):
    """sig, t, lower, upper: over half-overlapping tiles, the least of the greater running minima from both ends, and the greatest of
    the lesser running maxima (whose first values are those of the second sample)."""
    n = s.agg(F.max("t") + 1).first()[0] or 0
    tiled = s.withColumn("o", F.explode(fr.origins(F.col("t"), n, size, overlap)))
    own = Window.partitionBy("sig", "o").orderBy("t")
    every = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = [(F.min("v").over(own.rowsBetween(*side)), F.greatest(F.max("v").over(own.rowsBetween(*side)), second)) for side, second in ((_BEHIND, F.nth_value("v", 2).over(every)), (_AHEAD, F.nth_value("v", size - 1).over(every)))]
    e = tiled.select("sig", "t", F.greatest(ends[0][0], ends[1][0]).alias("lower"), F.least(ends[0][1], ends[1][1]).alias("upper"))
    return e.groupBy("sig", "t").agg(F.min("lower").alias("lower"), F.max("upper").alias("upper"))


_signal(
    "windowed_envelope",
    """, o AS (SELECT unnest(list_append(range(0, 670, 25), 670)) AS o), tl AS (SELECT sig.*, o FROM sig JOIN o ON t >= o AND t < o + 50), z AS (SELECT sig, o, max(v) FILTER (t = o + 1) AS a, max(v) FILTER (t = o + 48) AS b FROM tl GROUP BY sig, o),
 e AS (SELECT sig, t, greatest(min(v) OVER f, min(v) OVER g) AS lower, least(greatest(max(v) OVER f, a), greatest(max(v) OVER g, b)) AS upper FROM tl JOIN z USING (sig, o) WINDOW f AS (PARTITION BY sig, o ORDER BY t), g AS (PARTITION BY sig, o ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
 SELECT sig, t, round(min(lower), 6) AS lower, round(max(upper), 6) AS upper FROM e GROUP BY sig, t""",
    windowed_envelope,
)
_signal(
    "local_maxima",
    ", d AS (SELECT sig, t, v, sign(v - lag(v) OVER w) AS a, sign(lead(v) OVER w - v) AS b FROM sig WINDOW w AS (PARTITION BY sig ORDER BY t)) SELECT sig, t, round(v, 6) AS v FROM d WHERE b < a",
    lambda s, w: s.withColumn("a", F.signum(F.col("v") - F.lag("v").over(w))).withColumn("b", F.signum(F.lead("v").over(w) - F.col("v"))).where("b < a").select("sig", "t", "v"),
)
_signal(
    "signal_differences",
    "SELECT sig, t, round(lead(v) OVER w - v, 6) AS diff, round(CASE WHEN lag(v) OVER w IS NULL THEN lead(v) OVER w - v WHEN lead(v) OVER w IS NULL THEN v - lag(v) OVER w ELSE (lead(v) OVER w - lag(v) OVER w) / 2 END, 6) AS gradient, round(sum(v) OVER w, 4) AS total FROM sig WINDOW w AS (PARTITION BY sig ORDER BY t)",
    lambda s, w: s.select("sig", "t", (F.lead("v").over(w) - F.col("v")).alias("diff"), F.when(F.lag("v").over(w).isNull(), F.lead("v").over(w) - F.col("v")).when(F.lead("v").over(w).isNull(), F.col("v") - F.lag("v").over(w)).otherwise((F.lead("v").over(w) - F.lag("v").over(w)) / 2).alias("gradient"), F.round(F.sum("v").over(w), 4).alias("total")),
)


def robust_line(s, w, th: float = 3.0, rounds: int = 3):
    """sig, k, b: least squares line; samples further from it than th noise deviations (those of the steps over the root of 2) are left out of the next one."""
    ns = s.withColumn("d", F.lead("v").over(w) - F.col("v")).groupBy("sig").agg((F.stddev_pop("d") / 2**0.5).alias("ns"))
    own = s.join(ns, "sig").withColumn("near", F.lit(True))
    line = lambda df: df.where("near").groupBy("sig").agg(F.regr_slope("v", "t").alias("k"), F.regr_intercept("v", "t").alias("b"))
    for _ in range(rounds - 1):
        own = own.join(line(own), "sig").withColumn("near", F.abs(F.col("k") * F.col("t") + F.col("b") - F.col("v")) <= th * F.col("ns")).drop("k", "b")
    return line(own)


_signal(
    "robust_line",
    """, ns AS (SELECT sig, stddev_pop(d) / sqrt(2) AS ns FROM (SELECT sig, lead(v) OVER (PARTITION BY sig ORDER BY t) - v AS d FROM sig) GROUP BY sig),
 l1 AS (SELECT sig, regr_slope(v, t) AS k, regr_intercept(v, t) AS b FROM sig GROUP BY sig), s2 AS (SELECT sig.* FROM sig JOIN l1 USING (sig) JOIN ns USING (sig) WHERE abs(k * t + b - v) <= 3 * ns),
 l2 AS (SELECT sig, regr_slope(v, t) AS k, regr_intercept(v, t) AS b FROM s2 GROUP BY sig), s3 AS (SELECT sig.* FROM sig JOIN l2 USING (sig) JOIN ns USING (sig) WHERE abs(k * t + b - v) <= 3 * ns)
 SELECT sig, round(regr_slope(v, t), 6) AS k, round(regr_intercept(v, t), 6) AS b FROM s3 GROUP BY sig""",
    robust_line,
)


def rolling_sd(s, w, share: int = 10):
    """sig, t, sd: 1.4826 times the rolling median of distances from the rolling median, of the signal less its median over 20 samples;
    windows of a fifth of the signal, mirrored at its ends without repeating them."""
    n = s.agg(F.max("t") + 1).first()[0] or 0
    hw = n // share
    d = s.join(rank_filter(s, w, 20, 10).withColumnRenamed("v", "m"), ["sig", "t"]).select("sig", "t", (F.col("v") - F.col("m")).alias("v"))
    head = d.where(F.col("t").between(1, 2 * hw)).withColumn("t", -F.col("t"))
    tail = d.where(F.col("t").between(n - 1 - 2 * hw, n - 2)).withColumn("t", 2 * n - 2 - F.col("t"))
    own = w.rowsBetween(-hw, hw - 1)
    m = d.union(head).union(tail).withColumn("c", F.expr("percentile(v, 0.5)").over(own)).withColumn("full", F.count("v").over(own))
    m = m.withColumn("a", F.when(F.col("full") == 2 * hw, F.abs(F.col("v") - F.col("c"))))
    return m.withColumn("sd", 1.4826 * F.expr("percentile(a, 0.5)").over(own)).where(F.col("t").between(0, n - 1)).select("sig", "t", "sd")


_MEDIAN20 = "q20 AS (SELECT sig, t, v FROM sig UNION ALL SELECT sig, -1 - t, v FROM sig WHERE t < 20 UNION ALL SELECT sig, 1439 - t, v FROM sig WHERE t >= 700), m20 AS (SELECT sig, t, list_sort(list(v) OVER (PARTITION BY sig ORDER BY t ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING))[11] AS m FROM q20)"
_ROLLING = f"""{_MEDIAN20}, dt AS (SELECT sig, t, v - m AS v FROM sig JOIN m20 USING (sig, t)),
 pd AS (SELECT * FROM dt UNION ALL SELECT sig, -t, v FROM dt WHERE t BETWEEN 1 AND 144 UNION ALL SELECT sig, 1438 - t, v FROM dt WHERE t BETWEEN 575 AND 718),
 rc AS (SELECT sig, t, abs(v - quantile_cont(v, 0.5) OVER w) AS a, count(*) OVER w AS n FROM pd WINDOW w AS (PARTITION BY sig ORDER BY t ROWS BETWEEN 72 PRECEDING AND 71 FOLLOWING)),
 rs AS (SELECT sig, t, 1.4826 * quantile_cont(CASE WHEN n = 144 THEN a END, 0.5) OVER (PARTITION BY sig ORDER BY t ROWS BETWEEN 72 PRECEDING AND 71 FOLLOWING) AS sd FROM rc)"""
_signal("rolling_sd", f", {_ROLLING} SELECT sig, t, round(sd, 9) AS sd FROM rs WHERE t BETWEEN 0 AND 719", rolling_sd, 9)


def rolling_bias(s, w, th: float = 3.0):
    """sig, t, v: the median over a tenth of the signal, of samples within th rolling deviations of the median over half that window, and of
    that median in place of the others."""
    n = s.agg(F.max("t") + 1).first()[0] or 0
    size = n // 10
    near = s.join(rank_filter(s, w, size // 2, size // 4).withColumnRenamed("v", "m"), ["sig", "t"]).join(rolling_sd(s, w), ["sig", "t"])
    near = near.select("sig", "t", F.when(F.abs(F.col("v") - F.col("m")) <= th * F.col("sd"), F.col("v")).otherwise(F.col("m")).alias("v"))
    return rank_filter(near, w, size, size // 2)


_signal(
    "rolling_bias",
    f""", {_ROLLING}, p36 AS (SELECT sig, t, v FROM sig UNION ALL SELECT sig, -1 - t, v FROM sig WHERE t < 36 UNION ALL SELECT sig, 1439 - t, v FROM sig WHERE t >= 684),
 m36 AS (SELECT sig, t, list_sort(list(v) OVER (PARTITION BY sig ORDER BY t ROWS BETWEEN 18 PRECEDING AND 17 FOLLOWING))[19] AS m FROM p36),
 nr AS (SELECT sig, t, CASE WHEN abs(v - m) <= 3 * sd THEN v ELSE m END AS v FROM sig JOIN m36 USING (sig, t) JOIN rs USING (sig, t)),
 p72 AS (SELECT * FROM nr UNION ALL SELECT sig, -1 - t, v FROM nr WHERE t < 72 UNION ALL SELECT sig, 1439 - t, v FROM nr WHERE t >= 648),
 f72 AS (SELECT sig, t, list_sort(list(v) OVER (PARTITION BY sig ORDER BY t ROWS BETWEEN 36 PRECEDING AND 35 FOLLOWING))[37] AS v FROM p72) SELECT sig, t, round(v, 6) AS v FROM f72 WHERE t BETWEEN 0 AND 719""",
    rolling_bias,
)


def iterative_sd(s, w, cut: float = 5.0, rounds: int = 10):
    """sig, sd: the deviation after rounds in which samples over cut deviations from the mean are halved."""
    own = Window.partitionBy("sig")
    for _ in range(rounds):
        s = s.withColumn("sd", F.stddev_pop("v").over(own)).withColumn("v", F.when(F.abs(F.col("v") - F.avg("v").over(own)) > cut * F.col("sd"), F.col("v") * 0.5).otherwise(F.col("v")))
    return s.groupBy("sig").agg(F.first("sd").alias("sd"))


_signal(
    "iterative_noise_sd",
    ", i0 AS (SELECT sig, t, v FROM sig)" + "".join(f", i{k + 1} AS (SELECT sig, t, CASE WHEN abs(v - mu) > 5 * sd THEN v * 0.5 ELSE v END AS v, sd FROM i{k} JOIN (SELECT sig, stddev_pop(v) AS sd, avg(v) AS mu FROM i{k} GROUP BY sig) USING (sig))" if k == 0 else f", i{k + 1} AS (SELECT i.sig, t, CASE WHEN abs(v - mu) > 5 * a.sd THEN v * 0.5 ELSE v END AS v, a.sd FROM i{k} i JOIN (SELECT sig, stddev_pop(v) AS sd, avg(v) AS mu FROM i{k} GROUP BY sig) a USING (sig))" for k in range(10)) + " SELECT sig, round(any_value(sd), 6) AS sd FROM i10 GROUP BY sig",
    iterative_sd,
)


def between_separators(s, w, th: float = 100.0):
    """sig, t, lo, hi: each local maximum with the separators around it (lo <= t < hi): the samples at which the signal goes over th, and the ends."""
    up = (F.col("v") > th) & ~F.coalesce(F.lag("v").over(w) > th, F.lit(False))
    d = s.withColumn("peak", F.coalesce(F.signum(F.lead("v").over(w) - F.col("v")) < F.signum(F.col("v") - F.lag("v").over(w)), F.lit(False))).withColumn("cut", F.when(up, F.col("t")))
    n = F.max("t").over(Window.partitionBy("sig")) + 1
    d = d.withColumn("lo", F.coalesce(F.last("cut", True).over(w.rowsBetween(*_BEHIND)), F.lit(0).cast("long")))
    return d.withColumn("hi", F.coalesce(F.first("cut", True).over(w.rowsBetween(1, Window.unboundedFollowing)), n)).where("peak").select("sig", "t", "lo", "hi")


_signal(
    "locs_between_separators",
    """, d AS (SELECT *, v > 100 AND NOT coalesce(lag(v) OVER w > 100, false) AS up, sign(v - lag(v) OVER w) AS a, sign(lead(v) OVER w - v) AS b FROM sig WINDOW w AS (PARTITION BY sig ORDER BY t)),
 c AS (SELECT DISTINCT sig, t AS lo FROM d WHERE up UNION SELECT DISTINCT sig, 0 FROM sig), i AS (SELECT sig, lo, lead(lo, 1, 720) OVER (PARTITION BY sig ORDER BY lo) AS hi FROM c)
 SELECT d.sig, d.t, lo, hi FROM d JOIN i ON d.sig = i.sig AND d.t >= lo AND d.t < hi WHERE d.b < d.a""",
    between_separators,
)


def bin_counts(s, w):
    """t, n, k: at how many signals' samples over 100 begin at each hour of the day, the most frequent hour first (ties: the earlier)."""
    up = (F.col("v") > 100) & ~F.coalesce(F.lag("v").over(w) > 100, F.lit(False))
    n = s.withColumn("up", up).where("up").groupBy((F.col("t") % 24).alias("t")).agg(F.count("*").alias("n"))
    return n.withColumn("k", F.row_number().over(Window.orderBy(F.desc("n"), "t")))  # 24 rows


_signal(
    "bin_counts",
    ", d AS (SELECT t, v > 100 AND NOT coalesce(lag(v) OVER (PARTITION BY sig ORDER BY t) > 100, false) AS up FROM sig), n AS (SELECT t % 24 AS t, count(*) AS n FROM d WHERE up GROUP BY 1) SELECT t, n, CAST(row_number() OVER (ORDER BY n DESC, t) AS INTEGER) AS k FROM n",
    bin_counts,
)


def haar_fisz(s, w):
    """sig, t, d, s: halved differences of pairs over the root of their mean (0 if that is 0), and the means; and back: a, b. An unpaired last sample is its own mean."""
    even = F.col("t") % 2 == 0
    p = s.groupBy("sig", F.floor(F.col("t") / 2).alias("t")).agg(F.max(F.when(even, F.col("v"))).alias("a"), F.max(F.when(~even, F.col("v"))).alias("b"))
    p = p.withColumn("s", F.coalesce((F.col("a") + F.col("b")) / 2, "a")).withColumn("d", F.when(F.col("b").isNull() | (F.col("s") == 0), 0.0).otherwise((F.col("a") - F.col("b")) / 2 / F.sqrt("s"))).withColumn("paired", F.col("b").isNotNull())
    back = F.col("d") * F.sqrt("s")
    return p.select("sig", "t", "d", "s", (F.col("s") + back).alias("a"), F.when(F.col("paired"), F.col("s") - back).alias("b"))


_signal(
    "haar_fisz_step",
    ", p AS (SELECT sig, CAST(t // 2 AS BIGINT) AS t, max(CASE WHEN t % 2 = 0 THEN v END) AS a, max(CASE WHEN t % 2 = 1 THEN v END) AS b FROM sig GROUP BY 1, 2) SELECT sig, t, round(CASE WHEN a + b = 0 THEN 0 ELSE (a - b) / 2 / sqrt((a + b) / 2) END, 6) AS d, round((a + b) / 2, 6) AS s, round(a, 6) AS a, round(b, 6) AS b FROM p",
    haar_fisz,
)


def haar_levels(s, w, levels: int = 4):
    """sig, level, t, d: the differences of each level's pairs of means, and at level + 1 the means that are left; an unpaired last one goes up as it is."""
    out = []
    for level in range(1, levels + 1):
        even = F.col("t") % 2 == 0
        p = s.groupBy("sig", F.floor(F.col("t") / 2).alias("t")).agg(F.max(F.when(even, F.col("v"))).alias("a"), F.max(F.when(~even, F.col("v"))).alias("b"))
        s = p.select("sig", "t", F.coalesce((F.col("a") - F.col("b")) / 2, F.lit(0.0)).alias("d"), F.coalesce((F.col("a") + F.col("b")) / 2, "a").alias("v"))
        out.append(s.select("sig", F.lit(level).alias("level"), "t", "d"))
    out.append(s.select("sig", F.lit(levels + 1).alias("level"), "t", F.col("v").alias("d")))
    return out[0].union(out[1]).union(out[2]).union(out[3]).union(out[4])


_signal(
    "haar_pyramid",
    " UNION ALL ".join(f"SELECT sig, {k} AS level, CAST(t // {2**k} AS BIGINT) AS t, round(sum(CASE WHEN t % {2**k} < {2**k // 2} THEN v ELSE -v END) / {2**k}, 6) AS d FROM sig GROUP BY sig, t // {2**k}" for k in range(1, 5)) + " UNION ALL SELECT sig, 5 AS level, CAST(t // 16 AS BIGINT) AS t, round(sum(v) / 16, 6) AS d FROM sig GROUP BY sig, t // 16",
    haar_levels,
)

# --- smoothers


def _spline_sql(src: str, s: float) -> str:
    """z: the smoothing spline of src (sig, t, v), by sums of cosines."""
    return f"""c_ AS (SELECT s.sig, k.k, sum(s.v * cos(pi() * (s.t + 0.5) * k.k / 720)) AS c FROM {src} s CROSS JOIN (SELECT unnest(range(0, 720)) AS k) k GROUP BY 1, 2),
 g_ AS (SELECT sig, k, c * (CASE WHEN k = 0 THEN 1 ELSE 2 END) / 720 / (1 + {s**4} * (2 - 2 * cos(pi() * k / 720)) ** 2) AS c FROM c_),
 z AS (SELECT g.sig, t.t, sum(g.c * cos(pi() * (t.t + 0.5) * g.k / 720)) AS v FROM g_ g CROSS JOIN (SELECT unnest(range(0, 720)) AS t) t GROUP BY 1, 2)"""


_signal("l2_smooth", f", {_spline_sql('sig', 5.0)} SELECT sig, t, round(v, 5) + 0.0 AS v FROM z", lambda s, w: smoothers.per_signal(s, lambda v: smoothers.l2_spline(v, 5.0)).withColumn("v", F.round("v", 5) + 0.0))
_signal(
    "smoothed_median_filter",
    f", m10 AS (SELECT sig, t, list_sort(list(v) OVER (PARTITION BY sig ORDER BY t ROWS BETWEEN 5 PRECEDING AND 4 FOLLOWING))[6] AS v FROM (SELECT sig, t, v FROM sig UNION ALL SELECT sig, -1 - t, v FROM sig WHERE t < 10 UNION ALL SELECT sig, 1439 - t, v FROM sig WHERE t >= 710)), f10 AS (SELECT * FROM m10 WHERE t BETWEEN 0 AND 719), {_spline_sql('f10', 10.0)} SELECT sig, t, round(v, 5) + 0.0 AS v FROM z",
    lambda s, w: smoothers.per_signal(rank_filter(s, w, 10, 5), lambda v: smoothers.l2_spline(v, 10.0)).withColumn("v", F.round("v", 5) + 0.0),
)


def simple_label(s, w, th: float = 1.0, tau: float = 5.0):
    """sig, t of the samples whose smoothed value, in deviations of the signal, reaches th."""
    s = s.select("sig", "t", (F.col("v") / F.stddev_pop("v").over(Window.partitionBy("sig"))).alias("v"))
    return smoothers.per_signal(s, lambda v: smoothers.l2_spline(v, tau)).where(F.col("v") >= th).select("sig", "t")


def percentile_label(s, w, low: float = 0.025, tau: float = 2.0):
    """sig, t of the samples whose smoothed value reaches mu less the low percentile of the samples at or under mu, of the signal less its median; mu: its median if
    that is negative, else 0."""
    own = Window.partitionBy("sig")
    s = s.select("sig", "t", (F.col("v") - F.expr("percentile(v, 0.5)").over(own)).alias("v"))
    mu = s.groupBy("sig").agg(F.least(F.expr("percentile(v, 0.5)"), F.lit(0.0)).alias("mu"))
    th = s.join(mu, "sig").where("v <= mu").groupBy("sig", "mu").agg((F.col("mu") - F.expr(f"percentile(v, {low})")).alias("th"))
    return smoothers.per_signal(s, lambda v: smoothers.l2_spline(v, tau)).join(th, "sig").where("v >= th").select("sig", "t")


_signal("simple_label", f", d AS (SELECT sig, t, v / stddev_pop(v) OVER (PARTITION BY sig) AS v FROM sig), {_spline_sql('d', 5.0)} SELECT sig, t FROM z WHERE v >= 1", simple_label)
_signal(
    "percentile_label",
    f", c AS (SELECT sig, quantile_cont(v, 0.5) AS c FROM sig GROUP BY sig), d AS (SELECT sig, t, v - c AS v FROM sig JOIN c USING (sig)), mu AS (SELECT sig, least(quantile_cont(v, 0.5), 0) AS mu FROM d GROUP BY sig), th AS (SELECT sig, any_value(mu) - quantile_cont(v, 0.025) AS th FROM d JOIN mu USING (sig) WHERE v <= mu GROUP BY sig), {_spline_sql('d', 2.0)} SELECT sig, t FROM z JOIN th USING (sig) WHERE z.v >= th",
    percentile_label,
)


def transients(s, w, th: float = 1.5, low: float = 0.025, tau: float = 2.0):
    """sig, t, v: the signals' transients. Bias (the median within th rolling deviations of the median) is taken off, the rest is divided
    by the rolling deviations, labelled by percentile and put together again from the labelled samples."""
    noise = rolling_sd(s, w)
    own = Window.partitionBy("sig")
    d = s.join(noise, ["sig", "t"]).withColumn("sd", F.greatest("sd", F.lit(1e-9))).withColumn("c", F.col("v") - F.expr("percentile(v, 0.5)").over(own))
    d = d.withColumn("near", F.when(F.abs("c") <= th * F.col("sd"), F.col("v")))
    bias = F.coalesce(F.expr("percentile(near, 0.5)").over(own), F.lit(0.0))
    d = d.withColumn("v", (F.col("v") - bias) / F.col("sd")).select("sig", "t", "v", "sd")

    def run(x):
        x = x.sort_values("t")
        v = x["v"].to_numpy()
        mu = min(np.median(v), 0)
        on = smoothers.l2_spline(v, tau) >= mu - np.quantile(v[v <= mu], low)
        return x.assign(v=smoothers.reconstruct(v, on) * x["sd"].to_numpy())[["sig", "t", "v"]]

    return d.groupBy("sig").applyInPandas(run, "sig string, t long, v double")


_signal("transient_pipeline", None, transients)
_signal("l1_smooth", None, lambda s, w: smoothers.per_signal(s, lambda v: smoothers.l1_spline(v, 10.0)))
_signal("total_variation_smooth", None, lambda s, w: smoothers.per_signal(s, lambda v: smoothers.total_variation(v, 50.0)))
_signal("asymmetric_baseline", None, lambda s, w: smoothers.per_signal(s, smoothers.asymmetric_baseline))
_signal("clipped_smoothing_baseline", None, lambda s, w: smoothers.per_signal(s, smoothers.clipped_baseline))

# --- frames


def masks_at_levels(f, levels=(0.01, 0.25, 0.5, 0.75, 0.99)):
    """t, y, x, level: which of the ranges between quantiles of the whole stack a cell is in; none from the last on, or under the first."""
    own = fr.with_global(f, **{f"q{k}": fr.quantile(p) for k, p in enumerate(levels)})
    level = F.lit(None).cast("int")
    for k in range(len(levels) - 1):
        level = F.when((F.col("v") >= F.col(f"q{k}")) & (F.col("v") < F.col(f"q{k + 1}")), k).otherwise(level)
    return own.select("t", "y", "x", level.alias("level")).where("level is not null")


_LEVELS = "q AS (SELECT quantile_cont({c}, [0.01, 0.25, 0.5, 0.75, 0.99]) AS q FROM {src}), lv AS (SELECT unnest([0, 1, 2, 3]) AS level)"
_frame("masks_at_levels", f", {_LEVELS.format(c='v', src='fr')} SELECT t, y, x, level FROM fr, q, lv WHERE v >= q[level + 1] AND v < q[level + 2]", masks_at_levels)


def level_dynamics(f, levels=(0.01, 0.25, 0.5, 0.75, 0.99)):
    """t, level, v: mean of each frame over the pixels whose mean is between two quantiles of all pixels' means."""
    px = f.groupBy("y", "x").agg(F.avg("v").alias("v")).withColumn("t", F.lit(0))
    return f.join(masks_at_levels(px, levels).drop("t"), ["y", "x"]).groupBy("t", "level").agg(F.avg("v").alias("v"))


_frame("level_dynamics", f", px AS (SELECT y, x, avg(v) AS m FROM fr GROUP BY y, x), {_LEVELS.format(c='m', src='px')} SELECT t, level, round(avg(v), 6) AS v FROM fr JOIN px USING (y, x), q, lv WHERE m >= q[level + 1] AND m < q[level + 2] GROUP BY t, level", level_dynamics)
_frame("rescale_clipped", "SELECT t, y, x, round(least(greatest((v - 5.0) / 35.0, 0), 1), 6) AS v FROM fr", lambda f: f.select("t", "y", "x", F.least(F.greatest((F.col("v") - 5.0) / 35.0, F.lit(0.0)), F.lit(1.0)).alias("v")))
_frame("projections", "SELECT y, x, round(max(v), 6) AS top, round(min(v), 6) AS low, round(quantile_cont(v, 0.95), 6) AS p95, round(stddev_pop(v), 6) AS sd FROM fr GROUP BY y, x", lambda f: f.groupBy("y", "x").agg(F.max("v").alias("top"), F.min("v").alias("low"), fr.quantile(0.95).alias("p95"), F.stddev_pop("v").alias("sd")))


def _mirrored(f, n: int):
    """The frames with n rows and columns more on each side, mirrored with the edge repeated."""
    _, height, width = fr.extent(f)
    for c, size in (("y", height), ("x", width)):
        f = f.union(f.where(F.col(c) < n).withColumn(c, -1 - F.col(c))).union(f.where(F.col(c) >= size - n).withColumn(c, 2 * size - 1 - F.col(c)))
    return f


def adaptive_median(f, th: float = 5.0, side: int = 5):
    """t, y, x, v: cells further than th robust deviations of their pixel from the median of the side x side cells around are replaced by it."""
    h = side // 2
    offsets = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in range(-h, h + 1) for b in range(-h, h + 1)))
    sent = _mirrored(f, h).withColumn("o", F.explode(offsets)).select("t", (F.col("y") + F.col("o.a")).alias("y"), (F.col("x") + F.col("o.b")).alias("x"), "v")
    m = sent.groupBy("t", "y", "x").agg(F.get(F.array_sort(F.collect_list("v")), side * side // 2).alias("m"), F.count("*").alias("n")).where(F.col("n") == side * side)  # side * side values
    own = f.join(m, ["t", "y", "x"]).join(fr.mad_std(f), ["y", "x"])
    return own.select("t", "y", "x", F.when(F.abs(F.col("v") - F.col("m")) > th * F.col("mad"), F.col("m")).otherwise(F.col("v")).alias("v"))


_frame(
    "adaptive_median_filter",
    """, ix AS (SELECT unnest(range(-2, 12)) AS i), ms AS (SELECT i, CASE WHEN i < 0 THEN -1 - i WHEN i > 9 THEN 19 - i ELSE i END AS j FROM ix), pf AS (SELECT fr.t, a.i AS y, b.i AS x, v FROM fr JOIN ms a ON fr.y = a.j JOIN ms b ON fr.x = b.j),
 md AS (SELECT c.t, c.y, c.x, list_sort(list(p.v))[13] AS m FROM fr c JOIN pf p ON p.t = c.t AND p.y BETWEEN c.y - 2 AND c.y + 2 AND p.x BETWEEN c.x - 2 AND c.x + 2 GROUP BY 1, 2, 3),
 px AS (SELECT y, x, quantile_cont(v, 0.5) AS c FROM fr GROUP BY y, x), sd AS (SELECT y, x, 1.4826 * quantile_cont(abs(v - c), 0.5) AS mad FROM fr JOIN px USING (y, x) GROUP BY y, x)
 SELECT t, y, x, round(CASE WHEN abs(v - m) > 5 * mad THEN m ELSE v END, 6) AS v FROM fr JOIN md USING (t, y, x) JOIN sd USING (y, x)""",
    adaptive_median,
)


def mask_algebra(f):
    """t, y, x, either, both, odd: cells over the 0.9-quantile of the stack, or twice the mean of their pixel: in either, in both, in one only."""
    a, b = op.binary_movie(f).withColumn("a", F.lit(True)), fr.with_pixel(f, m=F.avg("v")).where("v > 2 * m").select("t", "y", "x", F.lit(True).alias("b"))
    both = a.join(b, ["t", "y", "x"], "full").select("t", "y", "x", F.coalesce("a", F.lit(False)).alias("a"), F.coalesce("b", F.lit(False)).alias("b"))
    return both.select("t", "y", "x", (F.col("a") | F.col("b")).alias("either"), (F.col("a") & F.col("b")).alias("both"), (F.col("a") != F.col("b")).alias("odd"))


_frame("mask_algebra", _movie(0.9) + ", px AS (SELECT y, x, avg(v) AS m FROM fr GROUP BY y, x), mb AS (SELECT t, y, x FROM fr JOIN px USING (y, x) WHERE v > 2 * m), u AS (SELECT * FROM mv UNION SELECT * FROM mb), i AS (SELECT * FROM mv INTERSECT SELECT * FROM mb) SELECT u.t, u.y, u.x, true AS either, i.t IS NOT NULL AS both, i.t IS NULL AS odd FROM u LEFT JOIN i ON u.t = i.t AND u.y = i.y AND u.x = i.x", mask_algebra)
_ERODE, _DILATE = "count(*) = 5", "count(*) > 0"
_frame("mask_opening_of_closing", _movie(0.5) + _cross("d1", "mv", _DILATE) + _cross("e1", "d1", _ERODE) + _cross("e2", "e1", _ERODE) + _cross("d2", "e2", _DILATE) + " SELECT * FROM d2", lambda f: op.opening(op.closing(op.binary_movie(f, 0.5), *fr.extent(f)[1:]), *fr.extent(f)[1:]))
_frame("mask_closing_of_opening", _movie(0.5) + _cross("e1", "mv", _ERODE) + _cross("d1", "e1", _DILATE) + _cross("d2", "d1", _DILATE) + _cross("e2", "d2", _ERODE) + " SELECT * FROM e2", lambda f: op.closing(op.opening(op.binary_movie(f, 0.5), *fr.extent(f)[1:]), *fr.extent(f)[1:]))
_frame(
    "objects_per_frame",
    _LABELS + ", o AS (SELECT t, label, count(*) AS n FROM lb GROUP BY t, label) SELECT t, count(*) AS objects, round(avg(n), 6) AS area, max(n) AS largest FROM o GROUP BY t",
    lambda f: op.label_frames(op.binary_movie(f), fr.extent(f)[2]).groupBy("t", "label").agg(F.count("*").alias("n")).groupBy("t").agg(F.count("*").alias("objects"), F.avg("n").alias("area"), F.max("n").alias("largest")),
)


def _events(f):
    _, height, width = fr.extent(f)
    return events3d.label_movie(op.label_frames(op.binary_movie(f), width), height * width)


_EVENTS = _movie(0.9).replace("SELECT t, y, x FROM", "SELECT t, y, x, v FROM") + """, rc AS (SELECT t, y, x, t * 100 + y * 10 + x AS l FROM mv UNION SELECT n.t, n.y, n.x, rc.l FROM rc JOIN mv n ON abs(n.t - rc.t) + abs(n.y - rc.y) + abs(n.x - rc.x) = 1),
 ev AS (SELECT t, y, x, min(l) AS event FROM rc GROUP BY t, y, x)"""
_frame("events_per_frame", _EVENTS + " SELECT t, count(DISTINCT event) AS events FROM ev GROUP BY t", lambda f: _events(f).select("t", "event").distinct().groupBy("t").agg(F.count("*").alias("events")))
_frame("event_flat_masks", _EVENTS + " SELECT DISTINCT event, y, x FROM ev", lambda f: _events(f).select("event", "y", "x").distinct())


def kept_event_cells(f):
    """t, y, x, event of the events that last over 1 frame and cover over 3 pixels."""
    e = _events(f)
    return e.join(events3d.metrics(e, f, 1, 3).where("keep").select("event"), "event", "left_semi").select("t", "y", "x", "event")


_frame("kept_event_cells", _EVENTS + ", k AS (SELECT event FROM ev GROUP BY event HAVING max(t) - min(t) + 1 > 1 AND count(DISTINCT y * 10 + x) > 3) SELECT t, y, x, event FROM ev SEMI JOIN k USING (event)", kept_event_cells)


def tile_overlaps(f, size: int = 4, overlap: int = 2, nhood: int = 1):
    """ay, ax, by, bx: for each tile the others that it starts or stops in, with the reference's bounds (touching counts); tiles of 1 + 2 * nhood steps' reach meet by bucket."""
    _, height, width = fr.extent(f)
    grid = f.select("y", "x").distinct().withColumn("ay", F.explode(fr.origins(F.col("y"), height, size, overlap))).withColumn("ax", F.explode(fr.origins(F.col("x"), width, size, overlap))).select("ay", "ax").distinct()
    # a tile touches those in its own bucket of size cells and in the two next to it
    near = F.explode(F.sequence(F.floor(F.col("ay") / size) - 1, F.floor(F.col("ay") / size) + 1)).alias("ky")
    sent = grid.select("ay", "ax", near).select("ay", "ax", "ky", F.explode(F.sequence(F.floor(F.col("ax") / size) - 1, F.floor(F.col("ax") / size) + 1)).alias("kx"))
    held = grid.select(F.col("ay").alias("by"), F.col("ax").alias("bx"), F.floor(F.col("ay") / size).alias("ky"), F.floor(F.col("ax") / size).alias("kx"))
    meets = lambda a, b: f"(({a} >= {b} and {a} < {b} + {size}) or ({a} + {size} >= {b} and {a} + {size} < {b} + {size}))"
    return sent.join(held, ["ky", "kx"]).where(meets("ay", "by") + " and " + meets("ax", "bx")).select("ay", "ax", "by", "bx")


_frame(
    "tile_overlap_pairs",
    ", o AS (SELECT unnest([0, 2, 4, 6]) AS o), g AS (SELECT a.o AS y, b.o AS x FROM o a, o b) SELECT CAST(a.y AS BIGINT) AS ay, CAST(a.x AS BIGINT) AS ax, CAST(b.y AS BIGINT) AS by, CAST(b.x AS BIGINT) AS bx FROM g a JOIN g b ON ((a.y >= b.y AND a.y < b.y + 4) OR (a.y + 4 >= b.y AND a.y + 4 < b.y + 4)) AND ((a.x >= b.x AND a.x < b.x + 4) OR (a.x + 4 >= b.x AND a.x + 4 < b.x + 4))",
    tile_overlaps,
)
_frame(
    "map_patches",
    ", o AS (SELECT unnest([0, 2, 4, 6]) AS o), tl AS (SELECT fr.*, a.o AS ty, b.o AS tx FROM fr JOIN o a ON y >= a.o AND y < a.o + 4 JOIN o b ON x >= b.o AND x < b.o + 4), p AS (SELECT ty, tx, max(v) - avg(v) AS s FROM tl GROUP BY ty, tx) SELECT y, x, round(avg(s), 6) AS v FROM (SELECT DISTINCT y, x, ty, tx FROM tl) JOIN p USING (ty, tx) GROUP BY y, x",
    lambda f: fr.tiles(f).select("y", "x", "ty", "tx").distinct().join(fr.tiles(f).groupBy("ty", "tx").agg((F.max("v") - F.avg("v")).alias("s")), ["ty", "tx"]).groupBy("y", "x").agg(F.avg("s").alias("v")),
)


def crop_by_shifts(spark, sf_dir):
    """t, y, x, v without twice the greatest shift on each side: the 0.99-quantile of each period's distances (ten times discount and tax), rounded up."""
    f = frames(spark, sf_dir)
    t = F.floor(F.datediff(F.col("l_shipdate"), F.lit("1995-01-02").cast("date")) / 28)
    moved = table(spark, sf_dir, "lineitem").groupBy(t.alias("t")).agg(F.expr("percentile(abs(10 * l_discount), 0.99)").alias("x"), F.expr("percentile(abs(10 * l_tax), 0.99)").alias("y"))
    most = F.broadcast(moved.agg(F.ceil(F.max("x")).alias("mx"), F.ceil(F.max("y")).alias("my")))
    _, height, width = fr.extent(f)
    return f.join(most).where(F.col("y").between(2 * F.col("my"), height - 2 * F.col("my") - 1) & F.col("x").between(2 * F.col("mx"), width - 2 * F.col("mx") - 1)).select("t", "y", "x", "v")


def sliding_hours(spark, sf_dir):
    """kind, start, n, v: events in windows of six hours that start every two (start: hours since 2024-01-01)."""
    e = table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "6 hours", "2 hours").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("v"))
    start = F.floor((F.unix_timestamp(F.col("w.start").cast("timestamp")) - 1704067200) / 3600)
    return _rounded(e.select(F.col("event_type").alias("kind"), start.alias("start"), "n", "v"), 4)


def names_by_suffix(spark, sf_dir, ends=("bolt", "widget")):
    """p_partkey, name: lower-case names, blanks as underscores, that end with any of the given words."""
    name = F.lower(F.regexp_replace("p_name", " ", "_"))
    fits = F.lit(False)
    for x in ends:
        fits = fits | F.endswith(name, F.lit(x))
    return table(spark, sf_dir, "part").where(fits).select("p_partkey", name.alias("name"))


def parameters_from_json(spark, sf_dir):
    """event_id, k: the parameter k of each event's JSON properties."""
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


QUERIES |= {q.__name__: q for q in (crop_by_shifts, sliding_hours, names_by_suffix, parameters_from_json)}
ORACLES |= {
    "crop_by_shifts": f"""WITH {FRAMES_SQL}, m AS (SELECT CAST(floor(date_diff('day', DATE '1995-01-02', CAST(l_shipdate AS DATE)) / 28.0) AS BIGINT) AS t, quantile_cont(abs(10 * l_discount), 0.99) AS x, quantile_cont(abs(10 * l_tax), 0.99) AS y FROM lineitem GROUP BY 1),
 s AS (SELECT ceil(max(x)) AS mx, ceil(max(y)) AS my FROM m) SELECT t, y, x, v FROM fr, s WHERE y BETWEEN 2 * my AND 9 - 2 * my AND x BETWEEN 2 * mx AND 9 - 2 * mx""",
    "sliding_hours": "SELECT event_type AS kind, CAST(floor((epoch(ts) - 1704067200) / 7200) * 2 - o AS BIGINT) AS start, count(*) AS n, round(sum(value), 4) AS v FROM events, (SELECT unnest([0, 2, 4]) AS o) GROUP BY 1, 2",
    "names_by_suffix": "SELECT p_partkey, lower(replace(p_name, ' ', '_')) AS name FROM part WHERE regexp_matches(lower(p_name), '(bolt|widget)$')",
    "parameters_from_json": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
}
