"""Whole jobs over frame stacks (t, y, x, v), and the places where a function of the user's goes in: of a pixel's signal, of a tile, of signals
taken from tiles. What such a function sees (a signal, a tile's cells in a stretch of frames) is one group; Spark deals the groups out."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillstack.functions.shared import cut
from rillstack.operators import events3d, labelers, masks, peaks, steps
from rillstack.operators import frames as fr
from rillstack.operators import windowed_svd as ws


def percentile_filter(v: np.ndarray, percentile: float, size: int) -> np.ndarray:
    """The sample of rank size * percentile / 100 in each window, ends mirrored."""
    half, rank = size // 2, min(size - 1, int(size * percentile / 100))
    p = np.pad(v, (half, size - 1 - half), mode="symmetric")
    return np.partition(np.lib.stride_tricks.sliding_window_view(p, size), rank, 1)[:, rank]


def pixelwise(frames: DataFrame, fn: Callable[[np.ndarray], np.ndarray], smooth: int = 5, low: float = 25.0) -> DataFrame:
    """t, y, x, v: fn of each pixel's signal, which is first cut to its running percentile and smoothed by normal weights (smooth 0: as it is)."""

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values("t")
        v = own["v"].to_numpy(float)
        if smooth > 0:
            v = peaks.gaussian(percentile_filter(v, low, smooth), smooth)
        return own.assign(v=np.asarray(fn(v), float))

    rows = frames.select("t", *fr.PIXEL, "v")
    return rows.groupBy(*fr.PIXEL).applyInPandas(run, rows.schema)


def map_tiles(frames: DataFrame, fn: Callable[[np.ndarray], np.ndarray], size: int = 10, overlap: int = 5) -> DataFrame:
    """y, x, v: mean over the overlapping tiles of what fn makes of a tile's cells (frames, rows, columns): a picture of the tile, or one number."""
    cells = fr.tiles(frames, size, overlap).select("t", *fr.PIXEL, "v", "ty", "tx")

    def run(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["t", "y", "x"])
        x = own["v"].to_numpy(float).reshape(-1, own["y"].nunique(), own["x"].nunique())
        first = own.iloc[: x[0].size]
        return first[fr.PIXEL].assign(v=np.broadcast_to(np.asarray(fn(x), float), x.shape[1:]).ravel())

    return cells.groupBy("ty", "tx").applyInPandas(run, "y long, x long, v double").groupBy(*fr.PIXEL).agg(F.avg("v").alias("v"))


def principal_baseline(frames: DataFrame, smoother: Callable[[np.ndarray], np.ndarray] = steps.savgol_rounds, most: int | None = None) -> DataFrame:
    """t, y, x, v: the stack's principal components over time (as many as reach the hard threshold and one more, `most` at most), each smoothed,
    put together again with the pixels' means. What is gathered is the square of the number of frames."""
    pixels = cut(frames.groupBy(*fr.PIXEL).agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "v"))), lambda p: p["v"]).alias("v")).withColumn("m", F.aggregate("v", F.lit(0.0), lambda a, b: a + b) / F.size("v")).withColumn("c", F.transform("v", lambda x: x - F.col("m"))))
    n, _, outer = ws.unpack(np.array(ws.products(pixels, [], "c").first().g), False)
    sv, u = ws.leading(outer, n, 1, most or 1 << 30)
    lean = ((u - u.mean(0)) ** 3).sum(0)
    u = u * np.where(lean < 0, -1.0, 1.0)
    slow = np.stack([smoother(c) for c in (u * sv).T], 1)  # frames x components
    known = frames.sparkSession.sparkContext.broadcast((u / sv, slow))

    def build(batches):
        back, slow = known.value
        for b in batches:
            for c, m, y, x in zip(b.column("c"), b.column("m").to_pylist(), b.column("y"), b.column("x"), strict=True):
                v = slow @ (back.T @ c.values.to_numpy()) + m
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(v))), pa.array([y.as_py()] * len(v)), pa.array([x.as_py()] * len(v)), pa.array(v)], ["t", "y", "x", "v"])

    return pixels.select(*fr.PIXEL, "m", "c").mapInArrow(build, "t long, y long, x long, v double")


def enhance(frames: DataFrame, pipeline: Callable[[DataFrame], DataFrame], size: int = 4, overlap: int = 2) -> DataFrame:
    """t, y, x, v: signals taken from the overlapping tiles (weighted means), put through a pipeline of signals (sig, t, v), and put back."""
    signals = fr.tile_signals(frames) if (size, overlap) == (4, 2) else fr.tiles(frames, size, overlap).withColumn("w", fr.tile_weight(size)).groupBy("ty", "tx", "t").agg((F.sum(F.col("v") * F.col("w")) / F.sum("w")).alias("v"))
    done = pipeline(signals.select(F.concat_ws(":", "ty", "tx").alias("sig"), "t", "v"))
    at = F.split("sig", ":")
    back = done.select(at[0].cast("long").alias("ty"), at[1].cast("long").alias("tx"), "t", F.col("v").alias("s"))
    cells = fr.tiles(frames, size, overlap).withColumn("w", fr.tile_weight(size)).select("t", *fr.PIXEL, "ty", "tx", "w").join(back, ["ty", "tx", "t"])
    return cells.groupBy("t", *fr.PIXEL).agg((F.sum(F.col("s") * F.col("w")) / (F.sum("w") + 1e-12)).alias("v"))


def process(frames: DataFrame, least_area: int = 9, least_duration: int = 3, peak: float = 0.05, threshold: float = 0.025, denoise: bool = True, labeler: labelers.Labeler | None = None, smoother: Callable[[np.ndarray], np.ndarray] = steps.savgol_rounds, tsize: int = 200) -> DataFrame:
    """t, y, x, f0, dfof, v: the default job. Baseline f0 by principal components, relative change dfof, denoised by the double-stage windowed SVD,
    transients of its tiles' signals, and of these (v) what lies in events over the threshold of some duration, area and height; 0 elsewhere."""
    f0 = principal_baseline(frames, smoother)
    rel = frames.join(f0.withColumnRenamed("v", "f0"), ["t", *fr.PIXEL]).select("t", *fr.PIXEL, "f0", F.when(F.abs("f0") > 1e-9, F.col("v") / F.col("f0") - 1).otherwise(0.0).alias("v"))
    rel = cut(rel)
    own = rel.select("t", *fr.PIXEL, "v")
    if denoise:
        own = cut(ws.denoise(own, tsize, 4, tsize // 2, 2, hood=32))
    found = cut(enhance(own, lambda s: labelers.pipeline(s, labeler)))
    height, width = fr.extent(frames)[1:]
    active = found.where(F.col("v") > threshold).select("t", *fr.PIXEL)
    events = cut(events3d.label_movie(masks.label_frames(active, width), height * width))
    kept = events3d.metrics(events, found, least_duration, least_area, peak).where("keep").select("event")
    cells = events.join(kept, "event").select("t", *fr.PIXEL, F.lit(True).alias("in"))
    out = rel.select("t", *fr.PIXEL, "f0").join(own.withColumnRenamed("v", "dfof"), ["t", *fr.PIXEL]).join(found, ["t", *fr.PIXEL]).join(cells, ["t", *fr.PIXEL], "left")
    return out.select("t", *fr.PIXEL, "f0", "dfof", F.when(F.col("in"), F.col("v")).otherwise(0.0).alias("v"))


def largest_regions(labels: DataFrame, n: int = 1, ratio: float = 0.0) -> DataFrame:
    """t, y, x, label of the n largest regions of each frame that have at least that share of the largest one's size; of equal ones the first."""
    sizes = labels.groupBy("t", "label").agg(F.count("*").alias("n"))
    w = Window.partitionBy("t")
    k = F.row_number().over(w.orderBy(F.desc("n"), "label"))
    keep = sizes.withColumn("k", k).withColumn("top", F.max("n").over(w)).where((F.col("k") <= n) & (F.col("n") >= ratio * F.col("top")))
    return labels.join(keep.select("t", "label"), ["t", "label"], "left_semi")


def large_regions(labels: DataFrame, least: int) -> DataFrame:
    """t, y, x, label of the regions of `least` cells or more."""
    keep = labels.groupBy("t", "label").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    return labels.join(keep.select("t", "label"), ["t", "label"], "left_semi")


def regions_with(labels: DataFrame, seeds: DataFrame, without: bool = False) -> DataFrame:
    """t, y, x, label of the regions that hold one of the seeds (t, y, x) or, without, none."""
    hit = labels.join(seeds.select("t", *fr.PIXEL), ["t", *fr.PIXEL], "left_semi").select("t", "label").distinct()
    return labels.join(hit, ["t", "label"], "left_anti" if without else "left_semi")


def refined(cells: DataFrame, height: int, width: int, least: int = 1, rounds: int = 1) -> DataFrame:
    """t, y, x: the mask with the cells whose 3 x 3 surroundings (edges mirrored) are mostly mask, over and over, without regions under `least` cells."""
    for _ in range(rounds):
        near = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)))
        # a cell counts for itself and its neighbours, and at an edge once more for the place that is mirrored onto it
        sent = cells.select("t", "y", "x", F.explode(near).alias("o")).select("t", (F.col("y") + F.col("o.a")).alias("y"), (F.col("x") + F.col("o.b")).alias("x"), F.col("y").alias("sy"), F.col("x").alias("sx"))
        sent = sent.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1))
        times = lambda c, s, n: 1 + ((F.col(c) == F.col(s)) & ((F.col(c) == 0) | (F.col(c) == n - 1))).cast("int") * (1 if n > 1 else 2)
        most = sent.groupBy("t", "y", "x").agg(F.sum(times("y", "sy", height) * times("x", "sx", width)).alias("n")).where(F.col("n") >= 5).select("t", "y", "x")
        cells = cells.select("t", "y", "x").union(most).distinct()
        if least > 1:
            cells = large_regions(masks.label_frames(cells, width), least).select("t", "y", "x")
    return cells


def surroundings(frames: DataFrame, before: int, after: int, mirrored: bool = True) -> DataFrame:
    """t, y, x, near: the values of the cells from `before` rows and columns before a cell to `after` behind it. Outside of the picture the cells are
    those mirrored at its edge, or the last ones."""
    _, height, width = fr.extent(frames)

    def inside(c: str, n: int):
        i = F.col(f"{c}_")
        if not mirrored:
            return F.least(F.greatest(i, F.lit(0)), F.lit(n - 1)).cast("long")
        i = F.pmod(i, F.lit(2 * n))
        return F.when(i < n, i).otherwise(2 * n - 1 - i).cast("long")

    steps_ = F.explode(F.sequence(F.lit(-before), F.lit(after)))
    cells = frames.select("t", "y", "x", steps_.alias("a")).select("t", "y", "x", (F.col("y") + F.col("a")).alias("y_"), steps_.alias("b"))
    cells = cells.withColumn("x_", F.col("x") + F.col("b")).select("t", "y", "x", inside("y", height).alias("sy"), inside("x", width).alias("sx"))
    return cells.join(frames.select("t", F.col("y").alias("sy"), F.col("x").alias("sx"), "v"), ["t", "sy", "sx"]).groupBy("t", "y", "x").agg(F.collect_list("v").alias("near"))  # (before + after + 1)**2 values


def adaptive_frames(frames: DataFrame, th: float = 5.0, side: int = 5, clusters: int = 0, reverse: bool = False) -> DataFrame:
    """t, y, x, v: cells further than th robust deviations (of their frame's distances) from the median of the side x side cells around become it. clusters:
    outliers in regions of so many cells or more stay as they are; reverse: all others become the median instead."""
    m = F.get(F.array_sort("near"), side * side // 2)
    d = frames.join(surroundings(frames, side // 2, side - 1 - side // 2).select("t", "y", "x", m.alias("m")), ["t", "y", "x"]).withColumn("d", F.col("v") - F.col("m"))
    own = Window.partitionBy("t")
    d = d.withColumn("c", F.abs(F.col("d") - F.expr("percentile(d, 0.5)").over(own))).withColumn("out", F.abs("d") > th * 1.4826 * F.expr("percentile(c, 0.5)").over(own))
    if clusters:
        kept = large_regions(masks.label_frames(d.where("out").select("t", "y", "x"), fr.extent(frames)[2]), clusters).select("t", "y", "x", F.lit(True).alias("in"))
        d = d.join(kept, ["t", "y", "x"], "left").withColumn("out", F.col("in").isNull() if reverse else F.col("out") & F.col("in").isNull())
    elif reverse:
        d = d.withColumn("out", ~F.col("out"))
    return d.select("t", "y", "x", F.when(F.col("out"), F.col("m")).otherwise(F.col("v")).alias("v"))


def forward_deviation(frames: DataFrame, size: int) -> DataFrame:
    """t, y, x, v: standard deviation of the size x size cells that begin at a cell; past the last row and column these are repeated."""
    near = surroundings(frames, 0, size - 1, mirrored=False).select("t", "y", "x", F.posexplode("near").alias("i", "v"))
    return near.groupBy("t", "y", "x").agg(F.stddev_pop("v").alias("v"))


def binned(rows: DataFrame, bins: dict[str, int], time: str = "t", trim: bool = True) -> DataFrame:
    """Sums of the blocks of a dense volume (axes, v). Blocks that reach over an edge are filled up with the least value of the last time block's
    frames; a last time block that isn't whole is left out unless trim is off."""
    ends = rows.agg(*(F.max(a).alias(a) for a in bins)).first()
    length = (ends[time] if ends[time] is not None else -1) + 1
    step, whole = bins[time], int(np.prod(list(bins.values())))
    fill = rows.where(F.col(time) >= length - min(step, length)).agg(F.min("v")).first()[0] or 0.0
    blocks = rows.groupBy(*(F.floor(F.col(a) / n).alias(a) for a, n in bins.items())).agg((F.sum("v") + fill * (whole - F.count("*"))).alias("v"))
    return blocks.where(F.col(time) < length // step) if trim and length % step else blocks


def stained_area(frames: DataFrame, th: float = 0.25, margin: int = 5, largest: int = 5, least: int = 50) -> DataFrame:
    """y, x: the largest regions of pixels whose mean reaches th, after a closing and an opening, without small ones and without the margin."""
    _, height, width = fr.extent(frames)
    high = frames.groupBy(*fr.PIXEL).agg(F.avg("v").alias("m")).where(F.col("m") >= th).select(F.lit(0).cast("long").alias("t"), *fr.PIXEL)
    open_ = masks.opening(masks.closing(high, height, width), height, width)
    regions = largest_regions(large_regions(masks.label_frames(open_, width), least), largest)
    inside = F.col("y").between(margin, height - margin - 1) & F.col("x").between(margin, width - margin - 1)
    return regions.where(inside).select(*fr.PIXEL)
