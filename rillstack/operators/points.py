"""Density clusters of the cells of masks, and points of small clusters that go to the nearest large one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstack.operators import events3d

#: Centres that are sent to all tasks at most.
MAX_CENTRES = 10_000


def _near(cells: DataFrame, radius: float) -> DataFrame:
    """Each cell of a mask (t, y, x) sent to the places of its frame within the radius, as t, y, x with the sender's sy, sx. The number of places
    depends on the radius alone."""
    reach = int(radius)
    steps = [(a, b) for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if a * a + b * b <= radius * radius]
    offsets = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in steps))
    return cells.withColumn("o", F.explode(offsets)).select("t", (F.col("y") + F.col("o.a")).alias("y"), (F.col("x") + F.col("o.b")).alias("x"), F.col("y").alias("sy"), F.col("x").alias("sx"))


def dense(cells: DataFrame, radius: float = 3.0, least: int = 5) -> DataFrame:
    """t, y, x of the cells with `least` cells or more (themselves too) within the radius in their frame."""
    own = cells.select("t", "y", "x")
    return _near(own, radius).join(own, ["t", "y", "x"]).groupBy("t", F.col("sy").alias("y"), F.col("sx").alias("x")).agg(F.count("*").alias("n")).where(F.col("n") >= least).select("t", "y", "x")


def cleaned(cells: DataFrame, radius: float = 3.0, least: int = 5) -> DataFrame:
    """t, y, x: the mask without its noise, the cells with no dense cell within the radius."""
    own = cells.select("t", "y", "x")
    return _near(dense(own, radius, least), radius).select("t", "y", "x").join(own, ["t", "y", "x"], "left_semi").distinct()


def density_clusters(cells: DataFrame, width: int, radius: float = 3.0, least: int = 5) -> DataFrame:
    """t, y, x, label: dense cells within the radius of each other are one cluster, named by the number (y * width + x) of its first dense cell;
    other cells belong to the first of the clusters of dense cells within the radius, or are left out."""
    own = cells.select("t", "y", "x")
    core = dense(own, radius, least)
    span = core.agg(F.coalesce(F.max("y"), F.lit(0)) + 1).first()[0] * width
    number = lambda t, y, x: F.col(t) * span + F.col(y) * width + F.col(x)
    pairs = _near(core, radius).join(core, ["t", "y", "x"]).select(number("t", "sy", "sx").alias("a"), number("t", "y", "x").alias("b")).where("a < b")
    roots = events3d.roots(core.select(number("t", "y", "x").alias("node")), pairs)
    named = core.withColumn("node", number("t", "y", "x")).join(roots, "node").select("t", "y", "x", (F.col("root") - F.col("t") * span).alias("label"))
    sent = _near(named.select("t", "y", "x"), radius).join(named.select("t", F.col("y").alias("sy"), F.col("x").alias("sx"), "label"), ["t", "sy", "sx"]).select("t", "y", "x", "label")
    edge = sent.join(own, ["t", "y", "x"], "left_semi").join(core, ["t", "y", "x"], "left_anti").groupBy("t", "y", "x").agg(F.min("label").alias("label"))
    return named.union(edge)


def correct_small_loads(points: DataFrame, least: int = 5, rounds: int = 1) -> DataFrame:
    """points (.., label, v: a vector) with the label of the nearest centre of a cluster with `least` points or more, where their own has fewer. Centres
    are the means of the clusters' points; of equally near ones the smaller label's is taken. Without a large cluster nothing changes."""
    for _ in range(rounds):
        sizes = points.groupBy("label").agg(F.count("*").alias("n"))
        if not sizes.where(F.col("n") < least).limit(1).count():
            break
        large = sizes.where(F.col("n") >= least).select("label")
        sums = points.join(large, "label").select("label", F.posexplode("v").alias("i", "p")).groupBy("label", "i").agg(F.avg("p").alias("p"))
        means = sums.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "p"))), lambda c: c["p"]).alias("v")).orderBy("label").limit(MAX_CENTRES + 1).collect()
        if not means:
            break
        if len(means) > MAX_CENTRES:
            raise ValueError(f"more than {MAX_CENTRES} large clusters")
        known = points.sparkSession.sparkContext.broadcast((np.array([r.label for r in means]), np.array([r.v for r in means], float)))
        at, columns = points.columns.index("label"), points.columns

        def move(batches, known=known, at=at, columns=columns):
            labels, centres = known.value
            for b in batches:
                v = b.column("v").flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(b), -1)
                own = b.column("label").to_numpy()
                small = np.flatnonzero(~np.isin(own, labels))
                new = own.copy()
                for i in range(0, len(small), 256):
                    far = ((v[small[i : i + 256], None] - centres[None]) ** 2).sum(2)
                    new[small[i : i + 256]] = labels[np.argmin(far, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(new, b.schema.field(at).type) if c == "label" else b.column(c) for c in columns], columns)

        points = points.mapInArrow(move, points.schema)
    return points
