"""The folder that executors share, and cutting the lineage of loops."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, which executors share; a folder of its own only where that is unset and all runs in one process, as in tests."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not where and not re.match(r"local(\[|$)", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(where or tempfile.mkdtemp(prefix="rillstack-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """df by way of the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()
