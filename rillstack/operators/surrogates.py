"""Seeded surrogates of signals and stacks: permutations and jitter by hashes of the places, so reruns and lost executors give the same rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _digest(salt: str, cols: list[str]) -> Column:
    return F.md5(F.concat_ws(":", F.lit(salt), *(F.col(c).cast("string") for c in cols)))


def normal(salt: str, cols: list[str]) -> Column:
    """A standard normal number for each place, from two uniform ones of 32 bits."""
    u = [(F.conv(F.substring(_digest(salt, cols), k, 8), 16, 10).cast("double") + 0.5) / 2**32 for k in (1, 9)]
    return F.sqrt(-2 * F.log(u[0])) * F.cos(2 * math.pi * u[1])


def shuffled(rows: DataFrame, keys: list[str], salt: str = "shuffle") -> DataFrame:
    """keys, t, v: each group's values in an order of their own; t must be dense from 0."""
    k = F.row_number().over(Window.partitionBy(*keys).orderBy(_digest(salt, [*keys, "t"]), "t"))
    return rows.select(*keys, (k - 1).cast("long").alias("t"), "v")


def jittered(rows: DataFrame, keys: list[str], sigma: dict[str, float], salt: str = "jitter") -> DataFrame:
    """keys, axes, v: cells swapped with others near them. In order of the axes each cell takes the value of a cell some normal number of
    steps off (within its group's extents) and gives that cell its own; the last value that a cell is given stays."""
    axes = list(sigma)
    own = rows.withColumns({f"last_{a}": F.max(a).over(Window.partitionBy(*keys)) for a in axes})
    for a in axes:
        step = F.round(normal(f"{salt}:{a}", [*keys, *axes]) * sigma[a]).cast("long")
        own = own.withColumn(f"to_{a}", F.least(F.greatest(F.col(a) + step, F.lit(0)), F.col(f"last_{a}")))
    turn = F.struct(*axes).alias("turn")
    gives = own.select(*keys, *(F.col(f"to_{a}").alias(a) for a in axes), turn, "v")
    takes = own.drop("v").join(rows.select(*keys, *(F.col(a).alias(f"to_{a}") for a in axes), "v"), [*keys, *(f"to_{a}" for a in axes)]).select(*keys, *axes, turn, "v")
    return gives.union(takes).groupBy(*keys, *axes).agg(F.max_by("v", "turn").alias("v"))


def anti_aliased(frames: DataFrame, rounds: int = 2, space: float = 0.33, time: float = 0.5) -> DataFrame:
    """t, y, x, v: mean of several jitters, each within the frames and then along time."""
    done = None
    for k in range(rounds):
        one = jittered(jittered(frames, ["t"], {"y": space, "x": space}, f"space{k}"), ["y", "x"], {"t": time}, f"time{k}").select("t", "y", "x", "v")
        done = one if done is None else done.union(one)
    return done.groupBy("t", "y", "x").agg(F.avg("v").alias("v"))
