"""Queries over the hourly signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rillstack.operators import baselines
from rillstack.operators import frames as fr
from rillstack.sources.fixtures import SIGNALS_SQL, signals


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sig, label, t, r): samples of runs whose residual over a rolling lower quartile exceeds 2 robust deviations."""
    w = Window.partitionBy("sig").orderBy("t")
    s = signals(spark, sf_dir).withColumn("f0", F.expr("percentile(v, 0.25)").over(w.rowsBetween(-12, 12))).withColumn("r", F.col("v") - F.col("f0"))
    s = s.withColumn("sd", 1.4826 * F.expr("percentile(abs(r), 0.5)").over(Window.partitionBy("sig"))).withColumn("on", F.col("r") > 2 * F.col("sd"))
    s = s.withColumn("up", F.when(F.col("on") & ~F.coalesce(F.lag("on").over(w), F.lit(False)), 1).otherwise(0)).withColumn("label", F.sum("up").over(w))
    return s.where("on").select("sig", "label", "t", "r")


def events_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First, last sample, peak, time to peak and mean of each event."""
    e = _events(spark, sf_dir).groupBy("sig", "label").agg(F.min("t").alias("start"), F.max("t").alias("stop"), F.max("r").alias("peak"), F.min(F.struct((-F.col("r")).alias("m"), "t")).alias("p"), F.avg("r").alias("vmean"))
    return e.select("sig", "label", "start", "stop", F.round("peak", 6).alias("peak"), (F.col("p.t") - F.col("start")).alias("time_to_peak"), F.round("vmean", 6).alias("vmean"))


EVENTS_SQL = SIGNALS_SQL + """,
 a AS (SELECT sig, t, v - quantile_cont(v, 0.25) OVER (PARTITION BY sig ORDER BY t ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING) AS r FROM sig),
 b AS (SELECT a.*, r > 2 * (1.4826 * m.m) AS hot FROM a JOIN (SELECT sig, quantile_cont(abs(r), 0.5) AS m FROM a GROUP BY sig) m USING (sig)),
 c AS (SELECT *, CASE WHEN hot AND NOT coalesce(lag(hot) OVER (PARTITION BY sig ORDER BY t), false) THEN 1 ELSE 0 END AS up FROM b),
 ev AS (SELECT * FROM (SELECT sig, t, r, hot, CAST(sum(up) OVER (PARTITION BY sig ORDER BY t) AS BIGINT) AS label FROM c) WHERE hot)"""

QUERIES = {"events_1d": events_1d}
ORACLES = {
    "events_1d": f"WITH {EVENTS_SQL} SELECT sig, label, min(t) AS start, max(t) AS stop, round(max(r), 6) AS peak, arg_min(t, (-r, t)) - min(t) AS time_to_peak, round(avg(r), 6) AS vmean FROM ev GROUP BY sig, label",
}


def _add(name: str, sql: str, build, digits: int = 6) -> None:
    """build: (signals, their window) -> DataFrame; doubles are rounded on both sides."""

    def query(spark, sf_dir):
        df = build(signals(spark, sf_dir), Window.partitionBy("sig").orderBy("t"))
        return df.select(*(F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))

    QUERIES[name], ORACLES[name] = query, f"WITH {SIGNALS_SQL} {sql}"


def rank_filter(s: DataFrame, w, size: int, rank: int) -> DataFrame:
    """sig, t, v: the sample of the given rank (from 0) in the window of `size` from t - size // 2 on, the ends mirrored."""
    half = size // 2
    v = F.element_at(F.array_sort(F.collect_list("v").over(w.rowsBetween(-half, size - 1 - half))), rank + 1)
    return baselines.within(baselines.mirrored(s, size).withColumn("v", v))


_PAD = "pd AS (SELECT sig, t, v FROM sig UNION ALL SELECT sig, -1 - t, v FROM sig WHERE t < 9 UNION ALL SELECT sig, 1439 - t, v FROM sig WHERE t >= 711)"
_RANK = ", {pad}, f AS (SELECT sig, t, list_sort(list(v) OVER (PARTITION BY sig ORDER BY t ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING))[{k}] AS v FROM pd) SELECT sig, t, round(v, 6) AS v FROM f WHERE t BETWEEN 0 AND 719"
_add("median_filter_t", _RANK.format(pad=_PAD, k=5), lambda s, w: rank_filter(s, w, 9, 4))
_add("percentile_filter_t", _RANK.format(pad=_PAD, k=3), lambda s, w: rank_filter(s, w, 9, 2))
_add("running_min", "SELECT sig, t, round(min(v) OVER (PARTITION BY sig ORDER BY t), 6) AS v FROM sig", lambda s, w: s.select("sig", "t", F.min("v").over(w).alias("v")))
_add(
    "tight_envelope",
    "SELECT sig, t, round(greatest(min(v) OVER a, min(v) OVER b), 6) AS lower, round(least(max(v) OVER a, max(v) OVER b), 6) AS upper FROM sig WINDOW a AS (PARTITION BY sig ORDER BY t ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY sig ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)",
    lambda s, w: s.select("sig", "t", *(f(g("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), g("v").over(w.rowsBetween(0, Window.unboundedFollowing))).alias(n) for f, g, n in ((F.greatest, F.min, "lower"), (F.least, F.max, "upper")))),
)
_add(
    "local_minima",
    ", d AS (SELECT sig, t, v, sign(v - lag(v) OVER w) AS a, sign(lead(v) OVER w - v) AS b FROM sig WINDOW w AS (PARTITION BY sig ORDER BY t)) SELECT sig, t, round(v, 6) AS v FROM d WHERE b > a",
    lambda s, w: s.withColumn("a", F.signum(F.col("v") - F.lag("v").over(w))).withColumn("b", F.signum(F.lead("v").over(w) - F.col("v"))).where("b > a").select("sig", "t", "v"),
)


def up_crossings(s: DataFrame, w, th: float = 100.0, nup: int = 2) -> DataFrame:
    """sig, t: starts of runs over th of nup samples or more."""
    on = F.col("v") > th
    runs = s.withColumn("g", F.sum(F.when(on & ~F.coalesce(F.lag(on).over(w), F.lit(False)), 1).otherwise(0)).over(w)).where(on)
    return runs.groupBy("sig", "g").agg(F.min("t").alias("t"), F.count("*").alias("n")).where(F.col("n") >= nup).select("sig", "t")


_add("up_crossings", ", d AS (SELECT *, CASE WHEN v > 100 AND NOT coalesce(lag(v) OVER (PARTITION BY sig ORDER BY t) > 100, false) THEN 1 ELSE 0 END AS up FROM sig), g AS (SELECT *, sum(up) OVER (PARTITION BY sig ORDER BY t) AS g FROM d) SELECT sig, min(t) AS t FROM g WHERE v > 100 GROUP BY sig, g HAVING count(*) >= 2", up_crossings)
_add(
    "rolling_mad",
    ", m AS (SELECT sig, t, v, abs(v - quantile_cont(v, 0.5) OVER (PARTITION BY sig ORDER BY t ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING)) AS d FROM sig) SELECT sig, t, round(1.4826 * quantile_cont(d, 0.5) OVER (PARTITION BY sig ORDER BY t ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING), 9) AS sd FROM m",
    lambda s, w: s.withColumn("d", F.abs(F.col("v") - F.expr("percentile(v, 0.5)").over(w.rowsBetween(-12, 11)))).select("sig", "t", (1.4826 * F.expr("percentile(d, 0.5)").over(w.rowsBetween(-12, 11))).alias("sd")),
    9,  # 1.4826 times a half cent has 7 digits
)
_add(
    "haar_step",
    "SELECT sig, CAST(t // 2 AS BIGINT) AS t, round((sum(CASE WHEN t % 2 = 0 THEN v ELSE -v END)) / 2, 6) AS d, round(sum(v) / 2, 6) AS s FROM sig GROUP BY sig, t // 2",
    lambda s, w: s.groupBy("sig", F.floor(F.col("t") / 2).alias("t")).agg(F.when(F.count("*") == 2, F.sum(F.when(F.col("t") % 2 == 0, F.col("v")).otherwise(-F.col("v"))) / 2).otherwise(0.0).alias("d"), (F.sum("v") / F.count("*")).alias("s")),  # an unpaired sample is its own mean
)


def windowed_running_min(s: DataFrame, size: int = 50) -> DataFrame:
    """sig, t, v: least over the half-overlapping tiles of the greater of the running minima from both ends of a tile."""
    tiled = s.withColumn("n", baselines.own_length()).withColumn("o", F.explode(fr.origins(F.col("t"), F.col("n"), size, size // 2)))
    w = Window.partitionBy("sig", "o").orderBy("t")
    ends = (F.min("v").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.min("v").over(w.rowsBetween(0, Window.unboundedFollowing)))
    return tiled.withColumn("v", F.greatest(*ends)).groupBy("sig", "t").agg(F.min("v").alias("v"))


_add(
    "windowed_runmin",
    ", o AS (SELECT unnest(list_append(range(0, 670, 25), 670)) AS o), tl AS (SELECT sig.*, o FROM sig JOIN o ON t >= o AND t < o + 50), e AS (SELECT sig, t, greatest(min(v) OVER (PARTITION BY sig, o ORDER BY t), min(v) OVER (PARTITION BY sig, o ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM tl) SELECT sig, t, round(min(v), 6) AS v FROM e GROUP BY sig, t",
    lambda s, w: windowed_running_min(s),
)


def lower_envelope(s: DataFrame, w) -> DataFrame:
    """sig, t, v: straight lines through the ends, the local minima and the shoulders (maxima of the second difference)."""
    a, b, c = F.lag("v").over(w), F.col("v"), F.lead("v").over(w)
    d = s.withColumn("low", F.signum(c - b) > F.signum(b - a)).withColumn("d", c - 2 * b + a)
    d = d.withColumn("high", F.signum(F.lead("d").over(w) - F.col("d")) < F.signum(F.col("d") - F.lag("d").over(w)))
    end = F.lag("t").over(w).isNull() | F.lead("t").over(w).isNull()
    knot = F.when(end | F.coalesce("low", F.lit(False)) | F.coalesce("high", F.lit(False)), F.struct("t", "v"))
    k = d.withColumn("k", knot)
    k = k.withColumn("p", F.last("k", True).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("q", F.first("k", True).over(w.rowsBetween(0, Window.unboundedFollowing)))
    line = F.col("p.v") + (F.col("q.v") - F.col("p.v")) * (F.col("t") - F.col("p.t")) / (F.col("q.t") - F.col("p.t"))
    return k.select("sig", "t", F.when(F.col("p.t") == F.col("q.t"), F.col("p.v")).otherwise(line).alias("v"))


_add(
    "lower_envelope",
    """, d AS (SELECT *, lag(v) OVER w AS a, lead(v) OVER w AS c, lead(v) OVER w - 2 * v + lag(v) OVER w AS d FROM sig WINDOW w AS (PARTITION BY sig ORDER BY t)),
 k AS (SELECT sig, t, v, a IS NULL OR c IS NULL OR coalesce(sign(c - v) > sign(v - a), false) OR coalesce(sign(lead(d) OVER w - d) < sign(d - lag(d) OVER w), false) AS knot FROM d WINDOW w AS (PARTITION BY sig ORDER BY t)),
 i AS (SELECT sig, t, max(t) FILTER (knot) OVER (PARTITION BY sig ORDER BY t) AS t0, min(t) FILTER (knot) OVER (PARTITION BY sig ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS t1 FROM k)
 SELECT i.sig, i.t, round(CASE WHEN t0 = t1 THEN p.v ELSE p.v + (q.v - p.v) * (i.t - t0) / (t1 - t0) END, 6) AS v FROM i JOIN sig p ON p.sig = i.sig AND p.t = t0 JOIN sig q ON q.sig = i.sig AND q.t = t1""",
    lower_envelope,
)


def adaptive_filter(s: DataFrame, w, th: float = 5.0, size: int = 5) -> DataFrame:
    """sig, t, v: samples further than th robust deviations from their median-filtered value are replaced by it."""
    own = Window.partitionBy("sig")
    m = rank_filter(s, w, size, size // 2).withColumnRenamed("v", "m")
    d = s.join(m, ["sig", "t"]).withColumn("c", F.abs(F.col("v") - F.expr("percentile(v, 0.5)").over(own))).withColumn("sd", 1.4826 * F.expr("percentile(c, 0.5)").over(own))
    return d.select("sig", "t", F.when(F.abs(F.col("v") - F.col("m")) > th * F.col("sd"), F.col("m")).otherwise(F.col("v")).alias("v"))


_add(
    "adaptive_filter_1d",
    ", pd AS (SELECT sig, t, v FROM sig UNION ALL SELECT sig, -1 - t, v FROM sig WHERE t < 5 UNION ALL SELECT sig, 1439 - t, v FROM sig WHERE t >= 715), f AS (SELECT sig, t, list_sort(list(v) OVER (PARTITION BY sig ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))[3] AS m FROM pd), c AS (SELECT sig, quantile_cont(v, 0.5) AS c FROM sig GROUP BY sig), sd AS (SELECT sig, 1.4826 * quantile_cont(abs(v - c), 0.5) AS sd FROM sig JOIN c USING (sig) GROUP BY sig) SELECT sig, t, round(CASE WHEN abs(v - m) > 5 * sd THEN m ELSE v END, 6) AS v FROM sig JOIN f USING (sig, t) JOIN sd USING (sig)",
    adaptive_filter,
)


def percentile_baseline(s: DataFrame, w, size: int = 25, rank: int = 6, th: float = 3.0) -> DataFrame:
    """sig, t, v: running rank (6 of 25: the lower quartile) between median-padded ends, shifted by the median of the
    residuals within th robust deviations (plain ones if those are 0) where there are more than 10."""
    half, own = size // 2, Window.partitionBy("sig")
    s = s.select("sig", "t", "v", baselines.own_length().alias("n"))
    span = lambda a: F.explode(F.sequence(a, a + (half - 1))).alias("t")
    pad = lambda cond, first: s.where(cond).groupBy("sig", "n").agg(F.expr("percentile(v, 0.5)").alias("v")).select("sig", span(first), "v", "n")
    padded = s.union(pad(F.col("t") < 10, F.lit(-half).cast("long"))).union(pad(F.col("t") >= F.col("n") - 10, F.col("n")))
    b = padded.withColumn("b", F.element_at(F.array_sort(F.collect_list("v").over(w.rowsBetween(-half, half))), rank + 1)).where((F.col("t") >= 0) & (F.col("t") < F.col("n")))
    d = b.withColumn("d", F.col("v") - F.col("b")).withColumn("c", F.abs(F.col("d") - F.expr("percentile(d, 0.5)").over(own)))
    d = d.withColumn("mad", 1.4826 * F.expr("percentile(c, 0.5)").over(own)).withColumn("sd", F.stddev_pop("d").over(own))
    d = d.withColumn("near", F.when(F.abs("d") <= th * F.when(F.col("mad") > 0, F.col("mad")).otherwise(F.col("sd")), F.col("d")))
    return d.select("sig", "t", (F.col("b") + F.when(F.count("near").over(own) > 10, F.expr("percentile(near, 0.5)").over(own)).otherwise(0.0)).alias("v"))


_add(
    "percentile_baseline",
    """, p AS (SELECT sig, t, v FROM sig UNION ALL SELECT sig, unnest(range(-12, 0)), quantile_cont(v, 0.5) FROM sig WHERE t < 10 GROUP BY sig UNION ALL SELECT sig, unnest(range(720, 732)), quantile_cont(v, 0.5) FROM sig WHERE t >= 710 GROUP BY sig),
 f AS (SELECT sig, t, v, list_sort(list(v) OVER (PARTITION BY sig ORDER BY t ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING))[7] AS b FROM p), d AS (SELECT *, v - b AS d FROM f WHERE t BETWEEN 0 AND 719),
 m AS (SELECT sig, quantile_cont(d, 0.5) AS m, stddev_pop(d) AS sd FROM d GROUP BY sig), n AS (SELECT sig, 1.4826 * quantile_cont(abs(d - m), 0.5) AS mad, any_value(sd) AS sd FROM d JOIN m USING (sig) GROUP BY sig),
 s AS (SELECT sig, CASE WHEN count(*) > 10 THEN quantile_cont(d, 0.5) ELSE 0 END AS shift FROM d JOIN n USING (sig) WHERE abs(d) <= 3 * CASE WHEN mad > 0 THEN mad ELSE sd END GROUP BY sig)
 SELECT sig, t, round(b + coalesce(shift, 0), 6) AS v FROM d LEFT JOIN s USING (sig)""",
    percentile_baseline,
)


def events_1d_topk(spark: SparkSession, sf_dir: str, n: int = 2) -> DataFrame:
    """sig, label, size, k: the n longest events of each signal; of equally long ones the earlier."""
    sizes = _events(spark, sf_dir).groupBy("sig", "label").agg(F.count("*").alias("size"))
    k = F.row_number().over(Window.partitionBy("sig").orderBy(F.desc("size"), "label"))
    return sizes.withColumn("k", k).where(F.col("k") <= n)


def events_1d_min_size(spark: SparkSession, sf_dir: str, least: int = 3) -> DataFrame:
    """sig, t of the samples in events of at least so many samples."""
    size = F.count("*").over(Window.partitionBy("sig", "label"))
    return _events(spark, sf_dir).withColumn("n", size).where(F.col("n") >= least).select("sig", "t")


def select_overlapping(spark: SparkSession, sf_dir: str, neg: bool = False, p: float = 0.9) -> DataFrame:
    """sig, t of the events that hold (neg: do not hold) a seed: a residual over the p-quantile of the signal's event samples."""
    e = _events(spark, sf_dir).withColumn("r", F.round("r", 6))
    e = e.withColumn("seed", F.col("r") > F.expr(f"percentile(r, {p})").over(Window.partitionBy("sig")))
    return e.join(e.where("seed").select("sig", "label"), ["sig", "label"], "left_anti" if neg else "left_semi").select("sig", "t")


QUERIES |= {
    "events_1d_topk": events_1d_topk,
    "events_1d_min_size": events_1d_min_size,
    "select_overlapping": select_overlapping,
    "select_nonoverlapping": lambda spark, sf_dir: select_overlapping(spark, sf_dir, neg=True),
}
_SEED = "(SELECT 1 FROM ev s JOIN (SELECT sig, quantile_cont(round(r, 6), 0.9) AS q FROM ev GROUP BY sig) q ON q.sig = s.sig WHERE s.sig = ev.sig AND s.label = ev.label AND round(s.r, 6) > q.q)"
ORACLES |= {
    "events_1d_topk": f"WITH {EVENTS_SQL}, z AS (SELECT sig, label, count(*) AS size FROM ev GROUP BY sig, label) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY sig ORDER BY size DESC, label) AS INTEGER) AS k FROM z) WHERE k <= 2",
    "events_1d_min_size": f"WITH {EVENTS_SQL}, z AS (SELECT sig, label FROM ev GROUP BY sig, label HAVING count(*) >= 3) SELECT sig, t FROM ev SEMI JOIN z USING (sig, label)",
    "select_overlapping": f"WITH {EVENTS_SQL} SELECT sig, t FROM ev WHERE EXISTS {_SEED}",
    "select_nonoverlapping": f"WITH {EVENTS_SQL} SELECT sig, t FROM ev WHERE NOT EXISTS {_SEED}",
}
