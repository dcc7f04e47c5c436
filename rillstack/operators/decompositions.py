"""Truncated singular value decompositions: of tall matrices and of tiles over time by their sums of outer products."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rillstack.operators import frames as fr


def hard_threshold(sv: np.ndarray, rows: int, cols: int) -> float:
    """Optimal hard threshold of singular values for unknown noise (Gavish and Donoho 2014), with their cubic for omega."""
    beta = min(rows, cols) / max(rows, cols)
    return float((0.56 * beta**3 - 0.95 * beta**2 + 1.82 * beta + 1.43) * np.median(sv))


def gram(rows: DataFrame, column: str, width: int) -> tuple[int, np.ndarray]:
    """Row count and sum of outer products; a task sends one width * width matrix, entries are summed by place."""

    def part(batches):
        n, g = 0, np.zeros((width, width))
        for b in batches:
            x = b.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)
            n, g = n + len(x), g + x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, width * width)), pa.array(np.concatenate(([n], g.ravel())))], ["k", "g"])

    parts = rows.where(F.size(column) == width).select(column).mapInArrow(part, "k long, g double")
    total = parts.groupBy("k").agg(F.sum("g").alias("g")).toPandas().set_index("k")["g"].sort_index().to_numpy()  # width * width + 1 rows
    return int(total[0]), total[1:].reshape(width, width)


def svht_rank(rows: DataFrame, column: str = "embedding", width: int = 64) -> DataFrame:
    """n_rows, threshold, n_components: how many singular values of the matrix of rows reach the hard threshold."""
    n, g = gram(rows, column, width)
    sv = np.sqrt(np.maximum(np.linalg.eigvalsh(g), 0))
    th = hard_threshold(sv, n, width) if n else 0.0
    return rows.sparkSession.createDataFrame([(n, th, int((sv >= th).sum()) if n else 0)], "n_rows long, threshold double, n_components long")


def _tile_grams(vectors: DataFrame, width: int) -> DataFrame:
    """ty, tx, k, g: each tile's frames (k = -1) and entries of the sum of outer products of its vectors c; a task sends one matrix a tile."""

    def part(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            own = b.column("c").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            tile = np.stack([b.column("ty").to_numpy(), b.column("tx").to_numpy()], 1)
            kinds, which = np.unique(tile, axis=0, return_inverse=True)
            for n, key in enumerate(kinds):
                x = own[which.ravel() == n]
                sums[tuple(key)] = sums.get(tuple(key), 0) + np.concatenate(([len(x)], (x.T @ x).ravel()))
        for (ty, tx), g in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), ty)), pa.array(np.full(len(g), tx)), pa.array(np.arange(-1, width * width)), pa.array(g)], ["ty", "tx", "k", "g"])

    return vectors.select("ty", "tx", "c").mapInArrow(part, "ty long, tx long, k long, g double").groupBy("ty", "tx", "k").agg(F.sum("g").alias("g"))


def svd_denoise(frames: DataFrame, size: int = 4, max_ncomps: int = 6) -> DataFrame:
    """t, y, x, v: each overlapping tile of the dense stack is variance-stabilised, centred on its pixels' means and put together again
    from as many components as reach the hard threshold, plus one (max_ncomps at most); tiles are overlapped by weights.

    The components come from the tile's matrix of outer products (size**4 entries, however long the recording is), and each frame
    is projected on them by itself."""
    width = size * size

    def project(entries: pd.DataFrame) -> pd.DataFrame:
        g = entries.sort_values("k")["g"].to_numpy()
        values, vectors = np.linalg.eigh(g[1:].reshape(width, width))
        sv = np.sqrt(np.maximum(values[::-1], 0))
        r = min(int((sv >= hard_threshold(sv, int(g[0]), width)).sum()) + 1, max_ncomps, width)
        u = vectors[:, ::-1][:, :r]
        return pd.DataFrame({"ty": entries["ty"].iloc[:1].to_numpy(), "tx": entries["tx"].iloc[:1].to_numpy(), "p": [(u @ u.T).ravel()]})

    stable = frames.withColumn("v", fr.anscombe(F.col("v")))
    cells = fr.tiles(fr.with_pixel(stable, m=F.avg("v")), size)
    rows = cells.groupBy("ty", "tx", "t").agg(F.sort_array(F.collect_list(F.struct("y", "x", "v", "m"))).alias("s"))  # width cells
    rows = rows.withColumn("c", F.transform("s", lambda x: x["v"] - x["m"]))
    own = _tile_grams(rows, width).groupBy("ty", "tx").applyInPandas(project, "ty long, tx long, p array<double>")
    line = lambda i: F.aggregate(F.zip_with(F.slice("p", i * width + 1, width), F.col("c"), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    new = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.struct(F.get(F.col("s"), i).alias("s"), line(i).alias("d")))
    done = rows.join(own, ["ty", "tx"]).select("ty", "tx", "t", F.explode(new).alias("n")).select("ty", "tx", "t", "n.s.y", "n.s.x", (F.col("n.s.m") + F.col("n.d")).alias("v")).withColumn("w", fr.tile_weight(size))
    back = done.groupBy("t", *fr.PIXEL).agg((F.sum(F.col("v") * F.col("w")) / (F.sum("w") + 1e-12)).alias("v"))
    return back.withColumn("v", fr.anscombe_inverse(F.col("v")))
