"""Events of a binary movie: components in time and space, with their measures.

Frames are labelled one by one; segments of frames next to each other that share a cell are linked, and only these
links (not the cells) go through the rounds that find the components.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstack.functions.shared import cut


def roots(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, root) for each of nodes (node), root the least node that links (a, b) reach.

    A round takes the least root of a node and its neighbours, then that root's own root, so chains shorten quickly.
    """
    both = cut(links.select("a", "b").union(links.select("b", "a")).distinct())
    own = cut(nodes.select("node", F.col("node").alias("root")))
    while True:
        near = both.join(own.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("least"))
        new = own.join(near, "node", "left").select("node", F.least("root", "least").alias("next"), F.col("root").alias("was"))
        jump = new.select(F.col("node").alias("next"), F.col("next").alias("far"))
        new = cut(new.join(jump, "next").select("node", F.least("next", "far").alias("root"), "was"))
        own = new.drop("was")
        if new.where("root < was").isEmpty():
            return own


def label_movie(labelled: DataFrame, cells: int) -> DataFrame:
    """t, y, x, event: frame labels (t, y, x, label) joined over time; an event is named by its least t * cells + label (cells: those of a frame)."""
    own = cut(labelled.withColumn("node", F.col("t") * cells + F.col("label")))
    later = own.select((F.col("t") - 1).alias("t"), "y", "x", F.col("node").alias("b"))
    links = own.join(later, ["t", "y", "x"]).select(F.col("node").alias("a"), "b").distinct()
    return own.join(roots(own.select("node").distinct(), links), "node").select("t", "y", "x", F.col("root").alias("event"))


def metrics(events: DataFrame, frames: DataFrame, min_duration: int = 3, min_area: int = 9, peak_threshold: float = 0.05) -> DataFrame:
    """One row an event: start, duration, frame of the largest area (from the start, first if tied) and that area, area of
    the projection, volume, peak and mean value; keep: over all three bounds."""
    cells = events.join(frames, ["t", "y", "x"])
    flat = cells.groupBy("event", "y", "x").agg(F.lit(1).alias("one")).groupBy("event").agg(F.count("*").alias("area"))
    per = cells.groupBy("event", "t").agg(F.count("*").alias("n"), F.sum("v").alias("s"), F.max("v").alias("m"))
    own = per.groupBy("event").agg(
        F.min("t").alias("start"),
        (F.max("t") - F.min("t") + 1).alias("duration"),
        (F.min_by("t", F.struct(-F.col("n"), F.col("t"))) - F.min("t")).alias("peak_area_frame"),
        F.max("n").alias("peak_area"),
        F.sum("n").alias("volume"),
        F.max("m").alias("peak"),
        (F.sum("s") / F.sum("n")).alias("avg"),
    )
    keep = (F.col("duration") > min_duration) & (F.col("peak") > peak_threshold) & (F.col("area") > min_area)
    return own.join(flat, "event").withColumn("keep", keep)


def common_jumps(frames: DataFrame, half: int, th: float = 1.0) -> DataFrame:
    """t at which the mean of either half of the picture (y under half, others) changes by over th standard deviations of its changes."""
    sides = []
    for side in (f"y < {half}", f"y >= {half}"):
        mean = frames.where(side).groupBy("t").agg(F.avg("v").alias("v"))  # one row a frame
        step = mean.join(mean.select((F.col("t") - 1).alias("t"), F.col("v").alias("w")), "t").select("t", (F.col("w") - F.col("v")).alias("d"))
        sides.append(step.join(F.broadcast(step.agg(F.stddev_pop("d").alias("sd")))).where(F.abs("d") > th * F.col("sd")).select("t"))
    return sides[0].intersect(sides[1])


def ages(segments: DataFrame, links: DataFrame, last: int, min_overlap: int = 4) -> DataFrame:
    """t, label, age, class of segments (t, label, node, overlap, next). A segment that shares too few cells with the frame before is 1 frame
    old, others are a frame older than the oldest one that they share cells with (links a -> b). class: 1 new, 2 continuing, 3 ending.

    As a link is one frame long, the age follows from the first frame that links reach; a round also takes what the ancestor found so far has reached."""
    new = F.col("overlap") < min_overlap / 4
    nodes = segments.withColumn("class", F.when((F.col("next") < min_overlap / 4) & (F.col("t") < last), 3).when(new, 1).otherwise(2)).withColumn("new", new)
    nodes = cut(nodes.select("t", "label", "node", "class", "new"))
    back = cut(links.join(nodes.where(~F.col("new")).select(F.col("node").alias("b")), "b").select("a", "b"))
    own = cut(nodes.select("node", F.struct("t", "node").alias("far")))
    while True:
        near = back.join(own.select(F.col("node").alias("a"), "far"), "a").groupBy(F.col("b").alias("node")).agg(F.min("far").alias("near"))
        step = own.join(near, "node", "left").select("node", F.least("far", "near").alias("next"), F.col("far").alias("was"))
        jump = own.select(F.col("node").alias("at"), F.col("far").alias("jump"))
        new_own = cut(step.join(jump, F.col("next.node") == F.col("at")).select("node", F.least("next", "jump").alias("far"), "was"))
        own = new_own.drop("was")
        if new_own.where("far < was").isEmpty():
            return nodes.join(own, "node").select("t", "label", (F.col("t") - F.col("far.t") + 1).alias("age"), "class")
