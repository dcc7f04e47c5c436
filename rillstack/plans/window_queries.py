"""Decompositions of the frame stack in windows, of its unfoldings, its dynamics and the signals' dynamics; numpy tests, as SQL has none of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillstack.operators import tensors
from rillstack.operators import windowed_svd as ws
from rillstack.sources.fixtures import frames, signals


def _rounded(df, digits: int = 5):
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def windowed_svd_denoise(spark, sf_dir):
    return _rounded(ws.denoise(frames(spark, sf_dir), 30, 5, 10, 2, stages="", stabilise=True))


def double_stage_denoise(spark, sf_dir):
    return _rounded(ws.denoise(frames(spark, sf_dir), 30, 5, 10, 2, hood=8, stabilise=True))


def hosvd_approximation(spark, sf_dir):
    return _rounded(tensors.hosvd_inverse(spark, tensors.hosvd(frames(spark, sf_dir), (None, 5, 5))))


def windowed_hosvd_denoise(spark, sf_dir):
    return _rounded(tensors.hosvd_denoise(frames(spark, sf_dir), 30, 5, 10, 2, stabilise=True))


def dmd_eigenvalues(spark, sf_dir):
    return _rounded(tensors.dmd(frames(spark, sf_dir), 2, 2)).select("ty", "tx", "k", "grows")


def dmd_denoise(spark, sf_dir):
    return _rounded(tensors.dmd_denoise(frames(spark, sf_dir), 2, 2), 4)


def dyca_components(spark, sf_dir):
    """t, k, v: the signals of all types, an array for each hour, on their dynamical components."""
    rows = signals(spark, sf_dir).groupBy("t").agg(F.transform(F.sort_array(F.collect_list(F.struct("sig", "v"))), lambda p: p["v"]).alias("v"))
    _, _, out = tensors.dyca(rows)
    if out is None:
        return spark.createDataFrame([], "t long, k int, v double")
    return _rounded(out.select("t", F.posexplode("v").alias("k", "v")), 4)


QUERIES = {q.__name__: q for q in (windowed_svd_denoise, double_stage_denoise, hosvd_approximation, windowed_hosvd_denoise, dmd_eigenvalues, dmd_denoise, dyca_components)}
ORACLES: dict[str, str] = {}
