"""Decompositions that need more than one matrix of products: of a stack's three unfoldings (higher-order SVD), of frames with their
successors (dynamic modes), and of signals with their derivatives (dynamical components).

The products are summed by task and then by group, so a recording is never in one place; what is gathered is the square of a mode's
length (a stack's frames, rows or columns, or a tile's pixels). Windowed forms hold one window, whose size is a parameter, in a group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstack.functions.shared import cut
from rillstack.operators import frames as fr
from rillstack.operators import windowed_svd as ws

MODES = ("t", "y", "x")


def unfolded(frames: DataFrame, mode: str) -> DataFrame:
    """The stack's vectors along a mode: the other two coordinates and c, in order of the mode."""
    others = [m for m in MODES if m != mode]
    return frames.groupBy(*others).agg(F.transform(F.sort_array(F.collect_list(F.struct(mode, "v"))), lambda p: p["v"]).alias("c"))


class Tucker:
    """Core (r0, r1, r2) and factors (length of the mode, rank) of a stack."""

    def __init__(self, core: np.ndarray, factors: list[np.ndarray]):
        self.core, self.factors = core, factors

    def collapsed(self) -> np.ndarray:
        """Core and the two factors in space as one: a picture for each component in time."""
        return np.einsum("abc,yb,xc->ayx", self.core, *self.factors[1:], optimize=True)


def hosvd(frames: DataFrame, ranks: tuple = (None, None, None), least: int = 1, most: int = 1 << 30) -> Tucker:
    """Each mode's leading vectors (as many as reach the hard threshold and one more, unless ranks says) and the core that the stack has in them."""
    factors = []
    for mode, rank in zip(MODES, ranks, strict=True):
        n, _, outer = ws.unpack(np.array(ws.products(unfolded(frames, mode), [], "c").first().g), False)
        factors.append(ws.leading(outer, n, least, most, rank)[1])
    u = frames.sparkSession.sparkContext.broadcast(factors)

    def part(batches):
        a, b, c = u.value
        total = np.zeros((a.shape[1] * b.shape[1], c.shape[1]))
        for batch in batches:
            t, y, rows = batch.column("t").to_numpy(), batch.column("y").to_numpy(), batch.column("c").values.to_numpy(zero_copy_only=False).reshape(-1, len(c))
            for i in range(0, len(t), 1024):
                both = a[t[i : i + 1024]][:, :, None] * b[y[i : i + 1024]][:, None, :]
                total += both.reshape(len(both), -1).T @ (rows[i : i + 1024] @ c)
        planes = total.reshape(a.shape[1], -1)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(planes))), pa.array(planes.tolist(), pa.list_(pa.float64()))], ["a", "v"])

    add = lambda own: own.iloc[:1].assign(v=[np.sum(np.stack(own["v"].to_list()), 0)])
    planes = unfolded(frames, "x").mapInArrow(part, "a long, v array<double>").groupBy("a").applyInPandas(add, "a long, v array<double>").collect()
    return Tucker(np.array([r.v for r in sorted(planes, key=lambda r: r.a)]).reshape([f.shape[1] for f in factors]), factors)


def hosvd_inverse(spark, tucker: Tucker) -> DataFrame:
    """t, y, x, v: the stack back from core and factors, a row of pixels at a time."""
    (length, _), (height, _), (width, _) = (f.shape for f in tucker.factors)
    known = spark.sparkContext.broadcast((tucker.factors[0], tucker.factors[1], np.tensordot(tucker.core, tucker.factors[2].T, 1)))

    def build(batches):
        a, b, rest = known.value
        for batch in batches:
            at = batch.column(0).to_numpy()
            for i in range(0, len(at), 256):
                t, y = np.divmod(at[i : i + 256], height)
                v = np.einsum("na,nb,abx->nx", a[t], b[y], rest, optimize=True)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(t, width)), pa.array(np.repeat(y, width)), pa.array(np.tile(np.arange(width), len(t))), pa.array(v.ravel())], ["t", "y", "x", "v"])

    return spark.range(length * height).mapInArrow(build, "t long, y long, x long, v double")


def adaptive_1d(v: np.ndarray, th: float, size: int) -> np.ndarray:
    """Samples further than th robust deviations of v from their running median (ends mirrored) become the median."""
    half = size // 2
    m = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(v, (half, size - 1 - half), mode="symmetric"), size), 1)
    return np.where(np.abs(v - m) > th * 1.4826 * np.median(np.abs(v - np.median(v))), m, v)


def hosvd_window(x: np.ndarray, ranks: tuple, least: int, most: int, tfilter: int, sfilter: int, percentile: float) -> np.ndarray:
    """One window (frames, rows, columns) approximated; small core entries under the percentile go, components are filtered in time and space."""
    factors = []
    for mode, rank in enumerate(ranks):
        m = np.moveaxis(x, mode, 0).reshape(x.shape[mode], -1)
        factors.append(ws.leading(m @ m.T, m.shape[1], least, most, rank)[1])
    core = np.einsum("tyx,ta,yb,xc->abc", x, *factors, optimize=True)
    if percentile > 0:
        core = np.where(np.abs(core) >= np.percentile(np.abs(core), percentile), core, 0)
    times, pictures = factors[0], Tucker(core, factors).collapsed()
    if tfilter > 0:
        times = np.stack([adaptive_1d(v, 3.0, tfilter) for v in times.T], 1)
    if sfilter > 0:
        pictures = np.stack([ws.adaptive_2d(p, 5.0, sfilter) for p in pictures])
    return np.tensordot(times, pictures, 1)


def hosvd_denoise(frames: DataFrame, tsize: int = 200, size: int = 8, toverlap: int = 100, overlap: int = 4, ranks: tuple | None = None, least: int = 1, most: int = 1 << 30, tfilter: int = 3, sfilter: int = 3, percentile: float = 0.0, stabilise: bool = False) -> DataFrame:
    """t, y, x, v: overlapping windows less their pixels' means, each approximated by its higher-order SVD (in space of half the window's
    rank unless ranks says), with fading weights. A window's tsize * size**2 cells are one group."""
    if stabilise:
        frames = frames.withColumn("v", fr.anscombe(F.col("v")))
    tsize, toverlap = ws.time_window(fr.extent(frames)[0], tsize, toverlap)
    ranks = ranks or (None, size // 2, size // 2)

    def window(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["t", "y", "x"])
        x = own["v"].to_numpy().reshape(tsize, size, size)
        centre = x.mean(0)
        return own.assign(v=(hosvd_window(x - centre, ranks, least, most, tfilter, sfilter, percentile) + centre).ravel())

    cells = ws.windows(frames, tsize, size, toverlap, overlap).select("t", *fr.PIXEL, "v", *ws.TILE)
    done = cells.groupBy(*ws.TILE).applyInPandas(window, cells.schema)
    w = ws.fade(F.col("t") - F.col("ts"), tsize, toverlap) * ws.fade(F.col("y") - F.col("ty"), size, overlap) * ws.fade(F.col("x") - F.col("tx"), size, overlap)
    sums = done.withColumn("w", w).groupBy("t", *fr.PIXEL).agg(F.sum(F.col("v") * F.col("w")).alias("v"), F.sum("w").alias("w"))
    v = F.when(F.col("w") > 1e-12, F.col("v") / (F.col("w") + 1e-12)).otherwise(0.0)
    return sums.select("t", *fr.PIXEL, (fr.anscombe_inverse(v) if stabilise else v).alias("v"))


def dynamic_modes(outer: np.ndarray, n: int, rank: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues and modes (columns) of the linear step from a vector to its successor. outer: sum of products of [vector, successor]; n: steps."""
    p = len(outer) // 2
    sv, u = ws.leading(outer[:p, :p], n, rank=rank)
    back = outer[p:, :p] @ u / sv**2
    values, w = np.linalg.eig(u.T @ back)
    order = np.argsort(np.abs(values), kind="stable")
    return values[order], (back @ w)[:, order]


def _steps(frames: DataFrame, nhood: int, stride: int) -> DataFrame:
    """ty, tx, t, c: pixels (in order of y, x) of the overlapping tiles of 2 * nhood + 1 cells; the last ones are cut off by the edge."""
    _, height, width = fr.extent(frames)
    side = 2 * nhood + 1
    own = frames.withColumn("ty", F.explode(fr.origins(F.col("y"), height + 1, side, side - stride))).withColumn("tx", F.explode(fr.origins(F.col("x"), width + 1, side, side - stride)))
    return own.repartition("ty", "tx").groupBy("ty", "tx", "t").agg(F.sort_array(F.collect_list(F.struct("y", "x", "v"))).alias("s"))


def _with_next(rows: DataFrame) -> DataFrame:
    """c: each frame's pixels followed by the next frame's."""
    own = rows.select("ty", "tx", "t", F.transform("s", lambda p: p["v"]).alias("c"))
    after = own.select("ty", "tx", (F.col("t") - 1).alias("t"), F.col("c").alias("d"))
    return own.join(after, ["ty", "tx", "t"]).select("ty", "tx", F.concat("c", "d").alias("c"))


def dmd(frames: DataFrame, nhood: int = 5, stride: int = 2, rank: int | None = None) -> DataFrame:
    """ty, tx, k, re, im, grows: each tile's dynamic modes by rising size of their eigenvalues; grows: the eigenvalue's absolute value."""

    def modes(own: pd.DataFrame) -> pd.DataFrame:
        n, _, outer = ws.unpack(own["g"].iloc[0], False)
        values, _ = dynamic_modes(outer, n, rank)
        return pd.DataFrame({"ty": own["ty"].iloc[0], "tx": own["tx"].iloc[0], "k": np.arange(len(values)), "re": values.real, "im": values.imag, "grows": np.abs(values)})

    return ws.products(_with_next(_steps(frames, nhood, stride)), ["ty", "tx"], "c").groupBy("ty", "tx").applyInPandas(modes, "ty long, tx long, k long, re double, im double, grows double")


def dmd_denoise(frames: DataFrame, nhood: int = 5, stride: int = 2, rank: int | None = None) -> DataFrame:
    """t, y, x, v: each frame's step ahead by its tiles' dynamic modes, averaged over the tiles."""
    rows = _steps(frames, nhood, stride)

    def step(own: pd.DataFrame) -> pd.DataFrame:
        n, _, outer = ws.unpack(own["g"].iloc[0], False)
        values, phi = dynamic_modes(outer, n, rank)
        return own[["ty", "tx"]].assign(m=[((phi * values) @ np.linalg.pinv(phi)).real.ravel()])

    known = cut(ws.products(_with_next(rows), ["ty", "tx"], "c").groupBy("ty", "tx").applyInPandas(step, "ty long, tx long, m array<double>"))

    def run(batches):
        for b in batches:
            out = []
            for m, c in zip(b.column("m"), b.column("c"), strict=True):
                x = c.values.to_numpy()
                out.append(m.values.to_numpy().reshape(len(x), -1) @ x)
            yield pa.RecordBatch.from_arrays([b.column("t"), b.column("at"), pa.array(out, pa.list_(pa.float64()))], ["t", "at", "c"])

    at = F.transform("s", lambda p: F.struct(p["y"].alias("y"), p["x"].alias("x")))
    done = rows.join(known, ["ty", "tx"]).select("t", at.alias("at"), F.transform("s", lambda p: p["v"]).alias("c"), "m").mapInArrow(run, "t long, at array<struct<y: long, x: long>>, c array<double>")
    cells = done.select("t", F.explode(F.arrays_zip("at", "c")).alias("z")).select("t", "z.at.y", "z.at.x", F.col("z.c").alias("v"))
    return cells.groupBy("t", *fr.PIXEL).agg(F.avg("v").alias("v"))


def gradients(rows: DataFrame) -> DataFrame:
    """t, v, d: vectors v of moments t (0, 1, ..) with their central differences, one-sided at the ends."""
    sent = rows.select("v", F.posexplode(F.array(F.col("t") + 1, "t", F.col("t") - 1)).alias("o", "t"))
    near = sent.groupBy("t").agg(*(F.max_by(F.when(F.col("o") == k, F.col("v")), F.col("o") == k).alias(name) for k, name in enumerate("avb")))
    less = lambda p, q, by: F.zip_with(p, q, lambda x, y: (x - y) / by)
    d = F.when(F.col("a").isNull(), less("b", "v", 1)).when(F.col("b").isNull(), less("v", "a", 1)).otherwise(less("b", "a", 2))
    return near.where("v is not null").select("t", "v", d.alias("d"))


def dyca(rows: DataFrame, least: int = 2, threshold: float = 0.98) -> tuple[np.ndarray, np.ndarray, DataFrame | None]:
    """Generalised eigenvalues (falling), projection (columns) and projected rows (t, v) of vectors v at moments t: directions in which the
    derivative is a linear function of the signals, and what it is a function of. Without a direction over the threshold, or where the
    products are singular, the projection is empty and there are no rows."""
    own = gradients(rows)
    n, _, outer = ws.unpack(np.array(ws.products(own.select(F.concat("v", "d").alias("c")), [], "c").first().g), False)
    p = len(outer) // 2
    c0, c1, c2 = outer[:p, :p] / n, outer[p:, :p] / n, outer[p:, p:] / n
    try:
        low = np.linalg.inv(np.linalg.cholesky(c2))
        values, y = np.linalg.eigh(low @ (c1 @ np.linalg.solve(c0, c1.T)) @ low.T)
        other = np.linalg.solve(c1, c2)
    except np.linalg.LinAlgError:
        return np.zeros(0), np.zeros((p, 0)), None
    values, vectors = np.abs(values), low.T @ y
    vectors /= np.linalg.norm(vectors, axis=0)
    order = np.argsort(-values, kind="stable")
    order = order[values[order] <= 1]
    values, vectors = values[order], vectors[:, order]
    if not len(values):
        return values, np.zeros((p, 0)), None
    keep = vectors[:, values > min(values[min(least, len(values)) - 1], threshold)]
    both = np.concatenate((keep, other @ keep), 1)
    if not keep.shape[1]:
        return values, both, None
    lines = F.array(*(F.array(*map(F.lit, line)) for line in both.T.tolist()))
    dot = lambda line: F.aggregate(F.zip_with(line, F.col("v"), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return values, both, own.select("t", F.transform(lines, dot).alias("v"))
