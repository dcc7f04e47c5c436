"""Every catalogued query against its SQL on the smallest tables."""

import glob
import os

import duckdb
import numpy as np
import pytest

from rillstack.plans import catalog

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_sql(spark, name):
    own = catalog.QUERIES[name](spark, DIR).toPandas()
    db = duckdb.connect()
    for p in glob.glob(f"{DIR}/*.parquet"):
        db.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    other = db.sql(catalog.ORACLES[name]).df()
    cols = sorted(own.columns)
    assert cols == sorted(other.columns) and len(own)
    a, b = (x[cols].astype(str).sort_values(cols).reset_index(drop=True) for x in (own, other))
    assert a.equals(b)


def test_imports_without_spark():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def test_roots_of_chains(spark):
    from rillstack.operators.events3d import roots

    nodes = spark.range(1, 42).toDF("node")
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 40) if k % 10] + [(5, 5)], "a long, b long")
    assert {r.node: r.root for r in roots(nodes, links).collect()} == {k: (k - 1) // 10 * 10 + 1 if k < 41 else 41 for k in range(1, 42)}


def test_svht_rank_is_that_of_the_whole_matrix(spark):
    from rillstack.operators.decompositions import hard_threshold

    x = np.stack(spark.read.parquet(f"{DIR}/embeddings.parquet").toPandas()["embedding"]).astype(float)
    sv = np.linalg.svd(x, compute_uv=False)
    th = hard_threshold(sv, *x.shape)
    row = catalog.QUERIES["svht_rank"](spark, DIR).first()
    assert (row.n_rows, row.n_components) == (len(x), (sv >= th).sum()) and abs(row.threshold - th) < 1e-6 * th


def test_svd_denoise_keeps_what_few_components_hold(spark):
    from pyspark.sql import functions as F

    from rillstack.operators.decompositions import svd_denoise
    from rillstack.operators.frames import anscombe_inverse, anscombe

    frames = spark.range(2000).selectExpr("id div 100 t", "id div 10 % 10 y", "id % 10 x").withColumn("v", 20.0 + 5 * (F.col("t") % 7))
    both = svd_denoise(frames).withColumnRenamed("v", "d").join(frames, ["t", "y", "x"])
    assert both.count() == 2000 and both.where(F.abs(F.col("d") - anscombe_inverse(anscombe(F.col("v")))) > 1e-6).isEmpty()


def test_stream_of_many_files_is_the_table(spark, tmp_path):
    from rillstack.streaming.hourly import follow, hourly

    events = spark.read.parquet(f"{DIR}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    rows = lambda df: {(r.sig, r.t): round(r.v, 6) for r in df.collect()}
    assert rows(follow(spark, str(tmp_path / "in"))) == rows(hourly(events))
