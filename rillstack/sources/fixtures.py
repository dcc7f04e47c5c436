"""Signals and frame stacks built from the given tables.

signals: (sig, t, v), one row for each hour of each event type; frames: (t, y, x, v), a dense stack of quantities
by shipping period. Both are dense: missing cells hold 0, so that row-based window frames mean what they say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOURS, PERIODS, ROWS, COLS = 720, 90, 10, 10


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sig, t, v): value summed by event type and hour since 2024-01-01, 0 where there is none."""
    hour = F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - 1704067200) / 3600)
    own = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("sig"), hour.cast("long").alias("t")).agg(F.sum("value").alias("v"))
    cells = own.select("sig").distinct().select("sig", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(HOURS - 1).cast("long"))).alias("t"))
    return cells.join(own, ["sig", "t"], "left").select("sig", "t", F.coalesce("v", F.lit(0.0)).alias("v"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, y, x, v): quantity summed by 28-day shipping period (0..89), supplier and part modulo 10, 0 where there is none."""
    li = table(spark, sf_dir, "lineitem")
    t = F.floor(F.datediff(F.col("l_shipdate"), F.lit("1995-01-02").cast("date")) / 28)
    own = li.groupBy(t.cast("long").alias("t"), (F.col("l_suppkey") % ROWS).alias("y"), (F.col("l_partkey") % COLS).alias("x")).agg(F.sum("l_quantity").alias("v"))
    own = own.where((F.col("t") >= 0) & (F.col("t") < PERIODS))
    axis = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    cells = spark.range(1).select(axis(PERIODS).alias("t")).select("t", axis(ROWS).alias("y")).select("t", "y", axis(COLS).alias("x"))
    return cells.join(own, ["t", "y", "x"], "left").select("t", "y", "x", F.coalesce("v", F.lit(0.0)).alias("v"))


#: The same as SQL.
SIGNALS_SQL = """sig AS (SELECT e.sig, h.t, coalesce(o.v, 0.0) AS v FROM (SELECT DISTINCT event_type AS sig FROM events) e
 CROSS JOIN (SELECT unnest(range(0, 720)) AS t) h
 LEFT JOIN (SELECT event_type AS sig, CAST(floor((epoch(ts) - 1704067200) / 3600) AS BIGINT) AS t, sum(value) AS v FROM events GROUP BY 1, 2) o ON o.sig = e.sig AND o.t = h.t)"""
FRAMES_SQL = """fr AS (SELECT a.t, b.y, c.x, coalesce(o.v, 0.0) AS v FROM (SELECT unnest(range(0, 90)) AS t) a CROSS JOIN (SELECT unnest(range(0, 10)) AS y) b CROSS JOIN (SELECT unnest(range(0, 10)) AS x) c
 LEFT JOIN (SELECT CAST(floor(date_diff('day', DATE '1995-01-02', CAST(l_shipdate AS DATE)) / 28.0) AS BIGINT) AS t, l_suppkey % 10 AS y, l_partkey % 10 AS x, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2, 3) o
 ON o.t = a.t AND o.y = b.y AND o.x = c.x)"""
