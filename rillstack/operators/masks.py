"""Operators over binary movies, kept as the rows (t, y, x) of the cells that are on: morphology, components, segment states.

A cell sends itself to its cross of five; what arrives is counted, so dilation and erosion are one shuffle each. Components
are found frame by frame (a frame is one group, which grows with the picture and not with the recording).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rillstack.operators import frames as fr

CELL = ["t", "y", "x"]
CROSS = [(0, 0), (-1, 0), (1, 0), (0, -1), (0, 1)]


def binary_movie(frames: DataFrame, p: float = 0.9) -> DataFrame:
    """t, y, x of the cells over the p-quantile of the whole stack; the one row of the quantile is broadcast."""
    th = frames.agg(F.expr(f"percentile(v, {p})").alias("th"))
    return frames.join(F.broadcast(th)).where("v > th").select(*CELL)


def _arrivals(mask: DataFrame, height: int, width: int) -> DataFrame:
    """t, y, x, n: how many cells of the cross around each cell of the frame are on."""
    cross = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in CROSS))
    sent = mask.withColumn("o", F.explode(cross)).select("t", (F.col("y") + F.col("o.a")).alias("y"), (F.col("x") + F.col("o.b")).alias("x"))
    return sent.where(F.col("y").between(0, height - 1) & F.col("x").between(0, width - 1)).groupBy(*CELL).agg(F.count("*").alias("n"))


def dilate(mask: DataFrame, height: int, width: int) -> DataFrame:
    return _arrivals(mask, height, width).select(*CELL)


def erode(mask: DataFrame, height: int, width: int) -> DataFrame:
    """Cells whose whole cross is on; what lies outside of the frame counts as off."""
    return _arrivals(mask, height, width).where(F.col("n") == len(CROSS)).select(*CELL)


def opening(mask: DataFrame, height: int, width: int) -> DataFrame:
    return dilate(erode(mask, height, width), height, width)


def closing(mask: DataFrame, height: int, width: int) -> DataFrame:
    return erode(dilate(mask, height, width), height, width)


def label_frames(mask: DataFrame, width: int) -> DataFrame:
    """t, y, x, label: 4-connected components of each frame, named by their smallest y * width + x."""

    def label(cells: pd.DataFrame) -> pd.DataFrame:
        y, x = cells["y"].to_numpy(), cells["x"].to_numpy()
        far = np.iinfo(np.int64).max
        grid = np.full((y.max() - y.min() + 3, x.max() - x.min() + 3), far)
        on = (y - y.min() + 1, x - x.min() + 1)
        own = y * width + x
        while True:
            grid[on] = own
            new = np.minimum.reduce([grid[on[0] + a, on[1] + b] for a, b in CROSS])
            if np.array_equal(new, own):
                return cells.assign(label=own)
            own = new

    return mask.groupBy("t").applyInPandas(label, "t long, y long, x long, label long")


def segments(labelled: DataFrame) -> DataFrame:
    """t, label, size, overlap (cells that were on a frame before), next (cells that are on a frame later)."""
    w = Window.partitionBy("y", "x").orderBy("t")
    near = labelled.withColumn("a", F.lag("t").over(w) == F.col("t") - 1).withColumn("b", F.lead("t").over(w) == F.col("t") + 1)
    return near.groupBy("t", "label").agg(F.count("*").alias("size"), F.count_if("a").alias("overlap"), F.count_if("b").alias("next"))


def segment_states(labelled: DataFrame, times: DataFrame, last: int, min_overlap: int = 4) -> DataFrame:
    """Per frame of `times`: inits, stops, carryover, avg_new_size (whole), growth_rate. A segment is new if fewer than
    min_overlap / 4 of its cells were on a frame before, and stops if fewer are on a frame later (never in the last frame)."""
    new, ends = F.col("overlap") < min_overlap / 4, (F.col("next") < min_overlap / 4) & (F.col("t") < last)
    per = segments(labelled).groupBy("t").agg(
        F.count("*").alias("total"),
        F.count_if(new).alias("inits"),
        F.count_if(ends).alias("stops"),
        F.floor(F.avg(F.when(new, F.col("size")))).alias("avg_new_size"),
        F.avg(F.when(~new, F.col("size") - F.col("overlap"))).alias("growth_rate"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    left = F.greatest(zero(F.col("total") - F.col("inits") - F.col("stops")), F.lit(0).cast("long"))
    return times.join(per, "t", "left").select(
        "t", zero("inits").alias("inits"), zero("stops").alias("stops"), left.alias("carryover"), zero("avg_new_size").alias("avg_new_size"), F.coalesce("growth_rate", F.lit(0.0)).alias("growth_rate")
    )


def neighbour_signals(frames: DataFrame, length: int, stride: int = 2, nhood: int = 2, max_take: int = 10) -> DataFrame:
    """cy, cx, t, v: around each centre, the sum of the signals that correlate with the centre's, weighted by correlation.

    Correlations under 2 / sqrt(length) (or undefined ones) count as 0, the max_take largest stay; weights sum to 1, plus 1e-6 each.
    """
    _, height, width = fr.extent(frames)

    def near(c, n):
        """Centres, every stride from nhood to before n - nhood, that c is near to."""
        first, last = F.ceil((F.greatest(F.col(c) - nhood, F.lit(nhood)) - nhood) / stride), F.floor((F.least(F.col(c) + nhood, F.lit(n - nhood - 1)) - nhood) / stride)
        return F.when(first <= last, F.transform(F.sequence(first, F.greatest(first, last)), lambda o: o * stride + nhood))

    patch = frames.withColumn("cy", F.explode(near("y", height))).withColumn("cx", F.explode(near("x", width)))
    centre = frames.select("t", F.col("y").alias("cy"), F.col("x").alias("cx"), F.col("v").alias("c"))
    r = patch.join(centre, ["t", "cy", "cx"]).groupBy("cy", "cx", "y", "x").agg(F.corr("v", "c").alias("r"))
    r = r.withColumn("r", F.when(~F.isnan("r") & (F.col("r") >= 2 / length**0.5), F.col("r")).otherwise(0.0))
    own = Window.partitionBy("cy", "cx")
    r = r.withColumn("k", F.row_number().over(own.orderBy(F.desc("r"), "y", "x"))).withColumn("r", F.when(F.col("k") <= max_take, F.col("r")).otherwise(0.0))
    w = r.withColumn("s", F.sum("r").over(own)).where("s > 0").select("cy", "cx", "y", "x", (F.col("r") / F.col("s") + 1e-6).alias("w"))
    return patch.join(w, ["cy", "cx", "y", "x"]).groupBy("cy", "cx", "t").agg(F.sum(F.col("v") * F.col("w")).alias("v"))
