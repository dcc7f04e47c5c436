"""Queries over streams, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from rillstack.streaming.hourly import follow


def stream_hourly(spark, sf_dir):
    # a pattern, as a stream takes folders or patterns but no single file
    return follow(spark, f"{sf_dir}/event[s].parquet").withColumn("v", F.round("v", 6))


QUERIES = {"stream_hourly": stream_hourly}
ORACLES = {"stream_hourly": "SELECT event_type AS sig, CAST(floor((epoch(ts) - 1704067200) / 3600) AS BIGINT) AS t, round(sum(value), 6) AS v FROM events GROUP BY 1, 2"}
