"""Queries over the frame stack and the embeddings, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from rillstack.operators import frames as op
from rillstack.sources.fixtures import FRAMES_SQL, frames, table

QUERIES, ORACLES = {}, {}


def _add(name: str, sql: str, build) -> None:
    """build: frames -> DataFrame; doubles are rounded to 6 digits on both sides."""

    def query(spark, sf_dir):
        df = build(frames(spark, sf_dir))
        return df.select(*(F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))

    QUERIES[name], ORACLES[name] = query, f"WITH {FRAMES_SQL} {sql}"


def _levels(f):
    px = f.groupBy("y", "x").agg(F.avg("v").alias("m"))  # one row a pixel
    level = F.ntile(4).over(Window.orderBy("m", "y", "x"))
    return f.join(px.select("y", "x", level.alias("level")), ["y", "x"]).groupBy("t", "level").agg(F.avg("v").alias("v"))


_PX = "px AS (SELECT y, x, quantile_cont(v, 0.5) AS m, quantile_cont(v, 0.85) AS q, avg(v) AS f0 FROM fr GROUP BY y, x), fp AS (SELECT fr.*, m, q, f0 FROM fr JOIN px USING (y, x))"
_ALL = "al AS (SELECT min(v) AS lo, max(v) AS hi, quantile_cont(v, 0.005) AS pl, quantile_cont(v, 0.995) AS ph FROM fr)"
_add("anscombe_fwd", "SELECT t, y, x, round(2 * sqrt(greatest(v, 0) + 0.375), 6) AS a FROM fr", lambda f: f.select("t", "y", "x", op.anscombe(F.col("v")).alias("a")))
_add("anscombe_inv", ", d AS (SELECT t, y, x, greatest(2 * sqrt(greatest(v, 0) + 0.375), 2 * sqrt(0.375) + 2e-16) AS d FROM fr) SELECT t, y, x, round(d * d / 4 - 0.125 + sqrt(1.5) / 4 / d - 1.375 / (d * d) + sqrt(1.5) * 0.625 / (d * d * d), 6) AS v FROM d", lambda f: f.select("t", "y", "x", op.anscombe_inverse(op.anscombe(F.col("v"))).alias("v")))
_add("rescale_minmax", f", {_ALL} SELECT t, y, x, round((v - lo) / (hi - lo), 6) AS v FROM fr, al", lambda f: op.with_global(f, lo=F.min("v"), hi=F.max("v")).select("t", "y", "x", op.rescale(F.col("v"), F.col("lo"), F.col("hi")).alias("v")))
_add("percentile_rescale", f", {_ALL} SELECT t, y, x, round((v - pl) / (ph - pl), 6) AS v FROM fr, al", lambda f: op.with_global(f, lo=op.quantile(0.005), hi=op.quantile(0.995)).select("t", "y", "x", op.rescale(F.col("v"), F.col("lo"), F.col("hi")).alias("v")))
_add("clip_outliers", f", {_ALL} SELECT t, y, x, round(least(greatest(v, pl), ph), 6) AS v FROM fr, al", lambda f: op.with_global(f, lo=op.quantile(0.005), hi=op.quantile(0.995)).select("t", "y", "x", F.least(F.greatest(F.col("v"), F.col("lo")), F.col("hi")).alias("v")))
_add("gain_offset_apply", "SELECT t, y, x, round(greatest((v - 3.0) / 2.5, 0), 6) AS v FROM fr", lambda f: f.select("t", "y", "x", F.greatest((F.col("v") - 3.0) / 2.5, F.lit(0.0)).alias("v")))
_add("varstab_convert", f", {_PX} SELECT t, y, x, round(((v - m) * (v - m) + 2 * (v - m) * m) / 4, 6) AS df, round(m * m / 4, 6) AS b FROM fp", lambda f: op.with_pixel(f, m=op.median()).select("t", "y", "x", *(c.alias(n) for c, n in zip(op.varstab_inverse(F.col("v") - F.col("m"), F.col("m")), ("df", "b"), strict=True))))
_add("dff", f", {_PX} SELECT t, y, x, round(CASE WHEN abs(f0) < 1e-5 THEN 0 ELSE v / f0 - 1 END, 6) AS v FROM fp", lambda f: op.with_pixel(f, f0=F.avg("v")).select("t", "y", "x", F.when(F.abs("f0") < 1e-5, 0.0).otherwise(F.col("v") / F.col("f0") - 1).alias("v")))
_add("pixel_mad_std", f", {_PX} SELECT y, x, round(1.4826 * quantile_cont(abs(v - m), 0.5), 6) AS mad FROM fp GROUP BY y, x", op.mad_std)
_add("pixel_std_median", f", {_PX} SELECT y, x, round(sqrt(avg((v - m) * (v - m))), 6) AS sd FROM fp GROUP BY y, x", op.std_median)
_add("pixel_bias", f", {_PX} SELECT y, x, round(quantile_cont(v, 0.5), 6) AS bias FROM fp WHERE abs(v - m) <= 60 GROUP BY y, x", op.bias)
_add("pixel_zscore", f", {_PX}, s AS (SELECT y, x, 1.4826 * quantile_cont(abs(v - m), 0.5) AS mad FROM fp GROUP BY y, x), b AS (SELECT y, x, quantile_cont(v, 0.5) AS bias FROM fp JOIN s USING (y, x) WHERE abs(v - m) <= 3 * mad GROUP BY y, x) SELECT t, y, x, round(CASE WHEN mad > 1e-5 THEN (v - bias) / (mad + 1e-5) ELSE 0 END, 6) AS z FROM fr JOIN b USING (y, x) JOIN s USING (y, x)", op.zscore)
_add("pixel_low_threshold", f", {_PX} SELECT y, x, round(0.0 - quantile_cont(v, 0.05), 6) AS th FROM fp WHERE v <= m GROUP BY y, x", op.low_threshold)
_add("top_average_projection", f", {_PX} SELECT y, x, round(avg(v), 6) AS top FROM fp WHERE v >= q GROUP BY y, x", op.top_average)
_add("bin_frames_2x2x2", "SELECT CAST(t // 2 AS BIGINT) AS t, CAST(y // 2 AS BIGINT) AS y, CAST(x // 2 AS BIGINT) AS x, round(sum(v), 6) AS v FROM fr GROUP BY 1, 2, 3", op.bin_frames)
_add("minute_max_maps", "SELECT CAST(t // 15 AS BIGINT) AS t, y, x, round(max(v), 6) AS v FROM fr GROUP BY 1, 2, 3", lambda f: f.groupBy(F.floor(F.col("t") / 15).alias("t"), "y", "x").agg(F.max("v").alias("v")))
_add("frame_stats", f", {_ALL} SELECT t, round(quantile_cont(v, 0.05), 6) AS p5, round(quantile_cont(v, 0.5), 6) AS p50, round(quantile_cont(v, 0.95), 6) AS p95, round(coalesce(avg(v) FILTER (v > 0), 0), 6) AS positive, count(*) FILTER (v > 30) AS active FROM fr GROUP BY t",
     lambda f: f.groupBy("t").agg(op.quantile(0.05).alias("p5"), op.quantile(0.5).alias("p50"), op.quantile(0.95).alias("p95"), F.coalesce(F.avg(F.when(F.col("v") > 0, F.col("v"))), F.lit(0.0)).alias("positive"), F.count_if(F.col("v") > 30).alias("active")))
_add("tile_mean_variance_gain", ", s AS (SELECT avg(v) AS mean, var_pop(v) AS var FROM fr GROUP BY t // 10, y // 5, x // 5) SELECT round(regr_slope(var, mean), 6) AS gain, round(-regr_intercept(var, mean) / regr_slope(var, mean), 6) AS offset_ FROM s", op.gain_and_offset)
_add("weighted_centroid", "SELECT t, round(sum(y * v) / sum(v), 6) AS cy, round(sum(x * v) / sum(v), 6) AS cx FROM fr GROUP BY t HAVING sum(v) > 0", lambda f: f.groupBy("t").agg((F.sum(F.col("y") * F.col("v")) / F.sum("v")).alias("cy"), (F.sum(F.col("x") * F.col("v")) / F.sum("v")).alias("cx"), F.sum("v").alias("s")).where("s > 0").drop("s"))
_add("brightness_level_dynamics", ", px AS (SELECT y, x, avg(v) AS m FROM fr GROUP BY y, x), lv AS (SELECT y, x, ntile(4) OVER (ORDER BY m, y, x) AS level FROM px) SELECT t, CAST(level AS INTEGER) AS level, round(avg(v), 6) AS v FROM fr JOIN lv USING (y, x) GROUP BY t, level", _levels)
_add("avg_filter_greater", "SELECT a.t, a.y, a.x, round(CASE WHEN any_value(a.v) > 20 THEN avg(b.v) FILTER (b.v > 20) ELSE 0 END, 6) AS v FROM fr a JOIN fr b ON a.t = b.t AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 GROUP BY a.t, a.y, a.x", lambda f: op.avg_filter_greater(f, 20.0))
_TILE = "o AS (SELECT unnest([0, 2, 4, 6]) AS o), tl AS (SELECT fr.*, a.o AS ty, b.o AS tx, exp(-0.5 * ((y - a.o - 1.5) * (y - a.o - 1.5) + (x - b.o - 1.5) * (x - b.o - 1.5)) / 2.25) AS w FROM fr JOIN o a ON y >= a.o AND y < a.o + 4 JOIN o b ON x >= b.o AND x < b.o + 4), ts AS (SELECT ty, tx, t, sum(v * w) / sum(w) AS s FROM tl GROUP BY ty, tx, t)"
_add("tile_avg_signals", f", {_TILE} SELECT CAST(ty AS BIGINT) AS ty, CAST(tx AS BIGINT) AS tx, t, round(s, 6) AS v FROM ts", op.tile_signals)
_add("ola_recombine", f", {_TILE} SELECT t, y, x, round(sum(s * w) / (sum(w) + 1e-12), 6) AS v FROM tl JOIN ts USING (ty, tx, t) GROUP BY t, y, x", op.overlap_add)




def comembership_counts(spark, sf_dir):
    """How many pairs of vectors (a vector with itself included) share each label; counted, not listed."""
    return table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n")).select("label", "n", F.expr("n * (n + 1) div 2").alias("pairs"))


QUERIES["comembership_counts"] = comembership_counts
ORACLES["comembership_counts"] = "SELECT a.label, count(DISTINCT a.vec_id) AS n, count(*) AS pairs FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <= b.vec_id GROUP BY a.label"
