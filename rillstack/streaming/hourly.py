"""Signals kept up to date from a stream of events."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstack.functions.shared import shared_folder


def hourly(events: DataFrame) -> DataFrame:
    """(sig, t, v): value summed by event type and hour since 2024-01-01; holds for tables and streams alike."""
    hour = F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - 1704067200) / 3600)
    return events.groupBy(F.col("event_type").alias("sig"), hour.cast("long").alias("t")).agg(F.sum("value").alias("v"))


def follow(spark: SparkSession, path: str, files: int = 1) -> DataFrame:
    """Reads the Parquet files of path as a stream, up to `files` a batch, until all there now are read, and returns the hourly signals.

    The state is one sum an hour and type, however many events come, and late ones count. Each batch replaces the
    table of its number in the shared folder, so a batch that is repeated after a loss writes the same again.
    """
    at = f"{shared_folder(spark)}/rillstack-stream-{uuid.uuid4().hex}"
    events = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(path)
    sums = hourly(events)
    last = []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{at}/table-{number}")
        last[:] = [f"{at}/table-{number}"]

    query = sums.writeStream.outputMode("complete").option("checkpointLocation", f"{at}/log").foreachBatch(keep).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(last[0]) if last else hourly(spark.read.parquet(path))
