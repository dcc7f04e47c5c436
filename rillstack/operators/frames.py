"""Operators over frame stacks (t, y, x, v): element-wise, per pixel, per frame, per tile. All are plain DataFrame operations:
per-pixel statistics aggregate by (y, x), frame statistics by t, tiles by division of the coordinates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PIXEL = ["y", "x"]


def anscombe(v: Column) -> Column:
    """Variance-stabilising transform 2 * sqrt(max(v, 0) + 3/8)."""
    return 2 * F.sqrt(F.greatest(v, F.lit(0.0)) + 0.375)


def anscombe_inverse(d: Column) -> Column:
    """Closed-form approximate unbiased inverse."""
    a = 1.5**0.5
    d = F.greatest(d, F.lit(2 * 0.375**0.5 + 2e-16))
    return d * d / 4 - 0.125 + a / 4 / d - 1.375 / (d * d) + a * 0.625 / (d * d * d)


def varstab_inverse(df: Column, b: Column) -> tuple[Column, Column]:
    """Difference and baseline back from variance-stabilised ones."""
    return (df * df + 2 * df * b) / 4, b * b / 4


def with_global(frames: DataFrame, **aggregates: Column) -> DataFrame:
    """The frames with global statistics beside each cell; the one row of statistics is broadcast."""
    return frames.join(F.broadcast(frames.agg(*(c.alias(k) for k, c in aggregates.items()))))


def with_pixel(frames: DataFrame, **aggregates: Column) -> DataFrame:
    """The frames with statistics of each pixel beside its cells."""
    return frames.join(frames.groupBy(*PIXEL).agg(*(c.alias(k) for k, c in aggregates.items())), PIXEL)


def median(c: str = "v") -> Column:
    return F.expr(f"percentile({c}, 0.5)")


def quantile(p: float, c: str = "v") -> Column:
    return F.expr(f"percentile({c}, {p})")


def rescale(v: Column, lo: Column, hi: Column) -> Column:
    """(v - lo) / (hi - lo); 0 for constant input."""
    return F.when(hi > lo, (v - lo) / (hi - lo)).otherwise(0.0)


def mad_std(frames: DataFrame) -> DataFrame:
    """y, x, mad: 1.4826 * median(|v - median|) of each pixel."""
    return with_pixel(frames, m=median()).withColumn("d", F.abs(F.col("v") - F.col("m"))).groupBy(*PIXEL).agg((1.4826 * median("d")).alias("mad"))


def std_median(frames: DataFrame) -> DataFrame:
    """y, x, sd: root mean square distance from the median."""
    return with_pixel(frames, m=median()).groupBy(*PIXEL).agg(F.sqrt(F.avg((F.col("v") - F.col("m")) * (F.col("v") - F.col("m")))).alias("sd"))


def bias(frames: DataFrame, th: float = 3.0, ns: float | DataFrame = 20.0) -> DataFrame:
    """y, x, bias: median of the samples within th * ns of the median; ns: a number, or (y, x, mad)."""
    own = with_pixel(frames, m=median())
    own, ns = (own.join(ns, PIXEL), F.col("mad")) if isinstance(ns, DataFrame) else (own, F.lit(ns))
    return own.where(F.abs(F.col("v") - F.col("m")) <= th * ns).groupBy(*PIXEL).agg(median().alias("bias"))


def zscore(frames: DataFrame) -> DataFrame:
    """t, y, x, z: (v - bias) / (mad + 1e-5), 0 where mad is not over 1e-5; the bias is that within three mad of the pixel."""
    mad = mad_std(frames)
    own = frames.join(bias(frames, 3.0, mad), PIXEL).join(mad, PIXEL)
    return own.select("t", *PIXEL, F.when(F.col("mad") > 1e-5, (F.col("v") - F.col("bias")) / (F.col("mad") + 1e-5)).otherwise(0.0).alias("z"))


def low_threshold(frames: DataFrame, p: float = 0.05) -> DataFrame:
    """y, x, th: minus the quantile of the samples at or under the median."""
    return with_pixel(frames, m=median()).where("v <= m").groupBy(*PIXEL).agg((F.lit(0.0) - quantile(p)).alias("th"))


def top_average(frames: DataFrame, p: float = 0.85) -> DataFrame:
    """y, x, top: mean of the samples at or over the quantile."""
    return with_pixel(frames, q=quantile(p)).where("v >= q").groupBy(*PIXEL).agg(F.avg("v").alias("top"))


def bin_frames(frames: DataFrame, tb: int = 2, yb: int = 2, xb: int = 2) -> DataFrame:
    """t, y, x, v: sums over blocks."""
    return frames.groupBy(F.floor(F.col("t") / tb).alias("t"), F.floor(F.col("y") / yb).alias("y"), F.floor(F.col("x") / xb).alias("x")).agg(F.sum("v").alias("v"))


def tile_statistics(frames: DataFrame, tt: int = 10, side: int = 5) -> DataFrame:
    """Mean and population variance of tiles that do not overlap."""
    return frames.groupBy(F.floor(F.col("t") / tt).alias("tt"), F.floor(F.col("y") / side).alias("ty"), F.floor(F.col("x") / side).alias("tx")).agg(F.avg("v").alias("mean"), F.var_pop("v").alias("var"))


def gain_and_offset(frames: DataFrame) -> DataFrame:
    """gain, offset_: slope and -intercept / slope of tile variance against tile mean."""
    s, i = F.regr_slope("var", "mean"), F.regr_intercept("var", "mean")
    return tile_statistics(frames).agg(s.alias("gain"), (-i / s).alias("offset_"))


def extent(frames: DataFrame) -> tuple[int, int, int]:
    """Length, height and width of the stack (t, y, x from 0), by one aggregate."""
    return tuple(frames.agg(*(F.coalesce(F.max(c) + 1, F.lit(0)) for c in ("t", *PIXEL))).first())


def neighbours(frames: DataFrame) -> DataFrame:
    """Each cell's value sent to the 3 x 3 cells around it: t, y, x, v of the sender, centre value c."""
    offsets = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
    sent = frames.withColumn("o", F.explode(offsets)).select("t", (F.col("y") + F.col("o.a")).alias("y"), (F.col("x") + F.col("o.b")).alias("x"), "v")
    return sent.join(frames.withColumnRenamed("v", "c"), ["t", *PIXEL])


def avg_filter_greater(frames: DataFrame, th: float) -> DataFrame:
    """t, y, x, v: mean of the 3 x 3 neighbours over th where the cell itself is, else 0."""
    return neighbours(frames).groupBy("t", *PIXEL).agg(F.when(F.first("c") > th, F.avg(F.when(F.col("v") > th, F.col("v")))).otherwise(0.0).alias("v"))


def origins(c: Column, n: int | Column, size: int, overlap: int) -> Column:
    """Origins of the tiles of 0 .. n - 1 that hold c: multiples of the step before n - size, and n - size (0 if n is smaller)."""
    step, last = size - overlap, F.greatest((F.lit(n) if isinstance(n, int) else n) - size, F.lit(0)).cast("long")
    first = F.greatest(F.lit(0), F.ceil((c - size + 1) / step)).cast("long")
    regular = F.filter(F.sequence(first, F.greatest(first, F.floor(c / step))), lambda o: (o * step < last) & (o * step <= c))
    return F.concat(F.transform(regular, lambda o: o * step), F.when(c >= last, F.array(last)).otherwise(F.array().cast("array<bigint>")))


def tiles(frames: DataFrame, size: int = 4, overlap: int = 2) -> DataFrame:
    """Cells with the origins (ty, tx) of all overlapping tiles that hold them; the last tile is at the edge."""
    _, height, width = extent(frames)
    return frames.withColumn("ty", F.explode(origins(F.col("y"), height, size, overlap))).withColumn("tx", F.explode(origins(F.col("x"), width, size, overlap)))


def tile_weight(size: int = 4, sigma: float = 1.5) -> Column:
    """Gaussian weight of a cell in its tile, centred at size / 2 - 0.5."""
    d = lambda c, o: F.col(c) - F.col(o) - (size / 2 - 0.5)
    return F.exp(-0.5 * (d("y", "ty") * d("y", "ty") + d("x", "tx") * d("x", "tx")) / (sigma * sigma))


def tile_signals(frames: DataFrame) -> DataFrame:
    """ty, tx, t, v: Gaussian-weighted mean of each overlapping tile in each frame."""
    w = tiles(frames).withColumn("w", tile_weight())
    return w.groupBy("ty", "tx", "t").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))


def overlap_add(frames: DataFrame) -> DataFrame:
    """t, y, x, v: tile signals put back on their cells, weighted."""
    cells = tiles(frames).withColumn("w", tile_weight()).select("t", *PIXEL, "ty", "tx", "w").join(tile_signals(frames), ["ty", "tx", "t"])
    return cells.groupBy("t", *PIXEL).agg((F.sum(F.col("v") * F.col("w")) / (F.sum("w") + 1e-12)).alias("v"))
