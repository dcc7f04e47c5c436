"""Truncated SVD of a frame stack (t, y, x, v) in windows of space and time, with a second stage over neighbouring windows.

A window is a tile in space and a stretch of frames, (ts, ty, tx); windows overlap. Its matrix has a row for each frame, its pixels less
their means. The components come from the sum of outer products of these rows (size**4 numbers a window, however many frames it has),
and each frame is projected on them by itself, so no task holds a window's frames together. Filters say where a component is, signals
when: both are scaled by the root of the singular value. Windows are put together again with weights that fade at their edges.

The second stage approximates the signals (or filters) of all windows that touch a neighbourhood by a truncated SVD of their own, again by
sums of outer products, and averages what a window gets from its neighbourhoods. Signals are vectors of a window's frames there, so the
frames of a window bound their size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rillstack.functions.shared import cut
from rillstack.operators import baselines
from rillstack.operators import frames as fr
from rillstack.operators.decompositions import hard_threshold

TILE = ["ts", "ty", "tx"]
#: Groups whose sums a task holds at most before it sends them on.
HELD = 256


def fade(x: Column, n: Column | int, overlap: float) -> Column:
    """Weight of place x of n: about 1 inside, falling over the overlap at both ends."""
    half = max(1.0, float(overlap)) / 2
    n = F.lit(n) if isinstance(n, int) else n
    both = F.tanh((x + 0.5 - half) / half) * F.tanh((n - (x + 0.5) - half) / half)
    return F.least(F.greatest((1.01 + both) / 2, F.lit(0.0)), F.lit(1.0))


def products(rows: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys, g: for each group [count, sum, flattened sum of outer products] of its vectors; a task sends one array for each group it meets."""
    kinds = ", ".join(f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys)

    def part(batches):
        sums: dict[tuple, np.ndarray] = {}

        def sent():
            names = list(zip(*sums, strict=True)) if keys else []
            yield pa.RecordBatch.from_arrays([*(pa.array(n) for n in names), pa.array([g.tolist() for g in sums.values()], pa.list_(pa.float64()))], [*keys, "g"])
            sums.clear()

        for b in batches:
            frame = b.select(keys).to_pandas() if keys else pd.DataFrame(index=range(len(b)))
            lists = b.column(vector)
            flat, off = lists.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            groups = frame.groupby(keys, sort=False).indices if keys else {(): np.arange(len(b))}
            for key, at in groups.items():
                key = tuple(key) if isinstance(key, tuple) else (key,)
                x = np.stack([flat[off[i] : off[i + 1]] for i in at])
                g = np.concatenate(([len(x)], x.sum(0), (x.T @ x).ravel()))
                sums[key] = sums[key] + g if key in sums else g
                if len(sums) >= HELD:
                    yield from sent()
        if sums:
            yield from sent()

    parts = rows.select(*keys, vector).mapInArrow(part, f"{kinds}{', ' if kinds else ''}g array<double>")

    def add(own: pd.DataFrame) -> pd.DataFrame:
        return own.iloc[:1].assign(g=[np.sum(np.stack(own["g"].to_list()), 0)])

    return (parts.groupBy(*keys) if keys else parts.groupBy()).applyInPandas(add, parts.schema)


def unpack(g: np.ndarray, centred: bool) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean (0 if not centred) and sum of outer products around it."""
    width = int((np.sqrt(4 * len(g) - 3) - 1) / 2)
    n, total, outer = int(g[0]), g[1 : 1 + width], g[1 + width :].reshape(width, width)
    mean = total / n if centred else np.zeros(width)
    return n, mean, outer - n * np.outer(mean, mean)


def leading(outer: np.ndarray, n: int, least: int = 1, most: int = 100, rank: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and right vectors (columns) that are kept: those at the hard threshold or over it and one more."""
    values, vectors = np.linalg.eigh(outer)
    sv = np.sqrt(np.maximum(values[::-1], 0))[: min(n, len(values))]
    r = int((sv >= hard_threshold(sv, n, len(values))).sum()) + 1 if rank is None else rank
    r = min(most, max(r, least), int((sv > 1e-9 * max(sv[0], 1e-300)).sum()))
    return sv[:r], vectors[:, ::-1][:, :r]


def median_2d(a: np.ndarray, size: int) -> np.ndarray:
    """Running median of size x size cells, the edges mirrored."""
    half = size // 2
    p = np.pad(a, ((half, size - 1 - half),) * 2, mode="symmetric")
    return np.median(np.lib.stride_tricks.sliding_window_view(p, (size, size)), (2, 3))


def adaptive_2d(a: np.ndarray, th: float = 5.0, size: int = 3) -> np.ndarray:
    """Cells further than th robust deviations (of all distances) from the running median become the median."""
    m = median_2d(a, size)
    d = a - m
    return np.where(np.abs(d) > th * 1.4826 * np.median(np.abs(d - np.median(d))), m, a)


def time_window(length: int, tsize: int, toverlap: int) -> tuple[int, int]:
    """Frames of a window and of its overlap: the whole stack if it is shorter, a quarter of the window if the overlap would be as long."""
    tsize = length if tsize <= 0 or tsize > length else tsize
    return tsize, tsize // 4 if toverlap >= tsize else toverlap


def windows(frames: DataFrame, tsize: int, size: int, toverlap: int, overlap: int) -> DataFrame:
    """Cells with the origins (ts, ty, tx) of the windows that hold them, dealt out by window."""
    length, height, width = fr.extent(frames)
    tsize, toverlap = time_window(length, tsize, toverlap)
    for origin, c, n, own, over in (("ts", "t", length, tsize, toverlap), ("ty", "y", height, size, overlap), ("tx", "x", width, size, overlap)):
        frames = frames.withColumn(origin, F.explode(fr.origins(F.col(c), n, own, over)))
    return frames.repartition(*TILE)


def decompose(frames: DataFrame, tsize: int = -1, size: int = 8, toverlap: int = 100, overlap: int = 4, least: int = 1, most: int = 100, tfilter: int = 3, sfilter: int = 3, centred: bool = True) -> tuple[DataFrame, DataFrame]:
    """filters (ts, ty, tx, n, k, s, centre and filter: arrays over the pixels in order of y, x) and signals (ts, ty, tx, k, t, v; t from the
    window's first frame). tfilter, sfilter: sizes of adaptive median filters of both, 0 for none."""
    cells = windows(frames, tsize, size, toverlap, overlap)
    rows = cells.groupBy(*TILE, "t").agg(F.transform(F.sort_array(F.collect_list(F.struct("y", "x", "v"))), lambda c: c["v"]).alias("c"))  # size * size cells

    def components(own: pd.DataFrame) -> pd.DataFrame:
        n, mean, outer = unpack(own["g"].iloc[0], centred)
        sv, u = leading(outer, n, least, most)
        key = {k: np.full(len(sv), own[k].iloc[0]) for k in TILE}
        return pd.DataFrame({**key, "n": n, "k": np.arange(len(sv)), "s": sv, "centre": [mean] * len(sv), "u": list(u.T)})

    parts = cut(products(rows, TILE, "c").groupBy(*TILE).applyInPandas(components, "ts long, ty long, tx long, n long, k long, s double, centre array<double>, u array<double>"))
    dot = F.aggregate(F.zip_with("u", F.zip_with("c", "centre", lambda a, b: a - b), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    raw = rows.join(parts, TILE).select(*TILE, "k", (F.col("t") - F.col("ts")).alias("t"), (dot / F.sqrt("s")).alias("v"))
    # signs: signals lean to the positive side
    third = raw.groupBy(*TILE, "k").agg(F.skewness("v").alias("skew")).select(*TILE, "k", F.when(F.col("skew") < 0, -1.0).otherwise(1.0).alias("sign"))
    signals = raw.join(third, [*TILE, "k"]).withColumn("v", F.col("v") * F.col("sign")).drop("sign")
    if tfilter > 0:
        signals = adaptive_1d(signals.select(F.struct(*TILE, "k").alias("sig"), "t", "v"), 3.0, tfilter).select("sig.*", "t", "v")

    def filtered(batches):
        for b in batches:
            u, c, s = b.column("u").to_pylist(), b.column("s").to_numpy(), b.column("sign").to_numpy()
            out = [np.array(x) * r**0.5 * g for x, r, g in zip(u, c, s, strict=True)]
            if sfilter > 0:
                out = [adaptive_2d(x.reshape(size, size), 5.0, sfilter).ravel() if len(x) == size * size else x for x in out]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in (*TILE, "n", "k", "s", "centre")), pa.array([x.tolist() for x in out], pa.list_(pa.float64()))], [*TILE, "n", "k", "s", "centre", "filter"])

    filters = parts.join(third, [*TILE, "k"]).mapInArrow(filtered, "ts long, ty long, tx long, n long, k long, s double, centre array<double>, filter array<double>")
    return filters, signals


def adaptive_1d(s: DataFrame, th: float, size: int) -> DataFrame:
    """sig, t, v: samples further than th robust deviations of the signal from their running median become the median."""
    half, own = size // 2, Window.partitionBy("sig")
    near = F.array_sort(F.collect_list("v").over(baselines.by_time().rowsBetween(-half, size - 1 - half)))
    m = baselines.within(baselines.mirrored(s, size).withColumn("v", F.element_at(near, half + 1))).withColumnRenamed("v", "m")
    d = s.join(m, ["sig", "t"]).withColumn("c", F.abs(F.col("v") - F.expr("percentile(v, 0.5)").over(own))).withColumn("sd", 1.4826 * F.expr("percentile(c, 0.5)").over(own))
    return d.select("sig", "t", F.when(F.abs(F.col("v") - F.col("m")) > th * F.col("sd"), F.col("m")).otherwise(F.col("v")).alias("v"))


def recompose(filters: DataFrame, signals: DataFrame, size: int, toverlap: int, overlap: int, length: int, fade_time: bool = True) -> DataFrame:
    """t, y, x, v: windows' filters times signals plus their centres, overlapped by fading weights (in time too, unless one window holds
    all `length` frames or fade_time is off: then windows weigh the same there)."""
    one = filters.groupBy(*TILE, "n").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("k", "filter"))), lambda f: f["filter"])).alias("f"), F.first("centre").alias("centre"))  # a window's components
    rows = signals.groupBy(*TILE, "t").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda z: z["v"]).alias("z")).join(one, TILE)

    def build(batches):
        for b in batches:
            z, f, c = ([x.values.to_numpy() for x in b.column(n)] for n in ("z", "f", "centre"))
            out = [centre + a @ own.reshape(len(a), -1) for a, own, centre in zip(z, f, c, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in (*TILE, "n", "t")), pa.array(out, pa.list_(pa.float64()))], [*TILE, "n", "t", "c"])

    built = rows.select(*TILE, "n", "t", "z", "f", "centre").mapInArrow(build, "ts long, ty long, tx long, n long, t long, c array<double>")
    cells = built.select(*TILE, "n", "t", F.posexplode("c").alias("i", "v"))
    y, x = F.floor(F.col("i") / size), F.col("i") % size
    w = F.when(F.col("n") < length, fade(F.col("t"), F.col("n"), toverlap)).otherwise(1.0) if fade_time else F.lit(1.0)
    cells = cells.select((F.col("ts") + F.col("t")).alias("t"), (F.col("ty") + y).cast("long").alias("y"), (F.col("tx") + x).cast("long").alias("x"), "v", (w * fade(y, size, overlap) * fade(x, size, overlap)).alias("w"))
    sums = cells.groupBy("t", *fr.PIXEL).agg(F.sum(F.col("v") * F.col("w")).alias("v"), F.sum("w").alias("w"))
    return sums.select("t", *fr.PIXEL, F.when(F.col("w") > 1e-12, F.col("v") / (F.col("w") + 1e-12)).otherwise(0.0).alias("v"))


def touching(tiles: DataFrame, height: int, width: int, size: int, hood: int) -> DataFrame:
    """The tiles (.., ty, tx) with each neighbourhood (hy, hx) that their first or last edge falls into; neighbourhoods overlap by half."""
    def holding(edge: str, n: int) -> Column:
        side = min(hood, n)
        grid = dict.fromkeys([*range(0, n - side, side - side // 2), n - side])  # bounded by the picture
        inside = lambda c, o: (c >= o) & (c < o + side)
        return F.explode(F.filter(F.array(*(F.lit(g).cast("long") for g in grid)), lambda o: inside(F.col(edge), o) | inside(F.col(edge) + size, o)))

    return tiles.withColumn("hy", holding("ty", height)).withColumn("hx", holding("tx", width))


def second_stage(rows: DataFrame, vector: str, height: int, width: int, size: int, hood: int) -> DataFrame:
    """rows (ts, ty, tx, k, vector) with each vector approximated by the leading components of all vectors of the neighbourhoods of its
    time window that its tile touches, averaged over them."""
    key = ["ts", "hy", "hx"]
    near = touching(rows, height, width, size, hood).select(*key, "ty", "tx", "k", F.col(vector).alias("c")).repartition(*key)

    def basis(own: pd.DataFrame) -> pd.DataFrame:
        n, _, outer = unpack(own["g"].iloc[0], False)
        _, u = leading(outer, n)
        return pd.DataFrame({**{k: own[k].iloc[:1].to_numpy() for k in key}, "b": [u.T.ravel()], "r": [u.shape[1]]})

    bases = cut(products(near, key, "c").groupBy(*key).applyInPandas(basis, "ts long, hy long, hx long, b array<double>, r long"))

    def project(batches):
        for b in batches:
            c, r = b.column("c").to_pylist(), b.column("r").to_numpy()
            flat, off = b.column("b").flatten().to_numpy(), np.concatenate(([0], np.cumsum(b.column("b").value_lengths().to_numpy())))
            out = []
            for i, x in enumerate(c):
                u, x = flat[off[i] : off[i + 1]].reshape(r[i], -1), np.array(x)
                out.append((u.T @ (u @ x)).tolist())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in (*TILE, "k")), pa.array(out, pa.list_(pa.float64()))], [*TILE, "k", "c"])

    many = near.join(bases, key).select(*TILE, "k", "c", "b", "r").mapInArrow(project, "ts long, ty long, tx long, k long, c array<double>")
    total = F.aggregate(F.slice("l", 2, F.size("l")), F.get("l", 0), lambda a, x: F.zip_with(a, x, lambda p, q: p + q))
    mean = many.groupBy(*TILE, "k").agg(F.collect_list("c").alias("l"))  # a few neighbourhoods
    return mean.select(*TILE, "k", F.transform(total, lambda x: x / (F.size("l") + 1e-7)).alias(vector))


def denoise(frames: DataFrame, tsize: int = 200, size: int = 8, toverlap: int = 100, overlap: int = 4, hood: int = 100, tfilter: int = 3, sfilter: int = 3, stages: str = "signals filters", stabilise: bool = False, fade_time: bool = True) -> DataFrame:
    """t, y, x, v: the stack put together again from its windows' components. `stages`: which of signals and filters go through the second
    stage; none: the windowed SVD alone. stabilise: between a variance-stabilising transform and its inverse."""
    if stabilise:
        frames = frames.withColumn("v", fr.anscombe(F.col("v")))
    length, height, width = fr.extent(frames)
    tsize, toverlap = time_window(length, tsize, toverlap)
    filters, signals = decompose(frames, tsize, size, toverlap, overlap, tfilter=tfilter, sfilter=sfilter)
    if "signals" in stages:
        vectors = cut(signals.groupBy(*TILE, "k").agg(F.transform(F.sort_array(F.collect_list(F.struct("t", "v"))), lambda p: p["v"]).alias("c")))  # a window's frames
        second = second_stage(vectors, "c", height, width, size, hood)
        signals = second.select(*TILE, "k", F.posexplode("c").alias("t", "v")).withColumn("t", F.col("t").cast("long"))
    if "filters" in stages:
        filters = cut(filters)
        second = second_stage(filters.select(*TILE, "k", "filter"), "filter", height, width, size, hood)
        filters = filters.drop("filter").join(second, [*TILE, "k"])
    out = recompose(filters, signals, size, toverlap, overlap, length, fade_time)
    return out.withColumn("v", fr.anscombe_inverse(F.col("v"))) if stabilise else out
