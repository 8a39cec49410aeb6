"""Windowed aggregation with the same code for a batch and for a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def per_window(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events counted by type and tumbling window; rows later than ``late`` are left out of a stream."""
    timed = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark("ts", late)
    counted = timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"))
    return counted.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "event_type", "n")


def tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return per_window(spark.read.parquet(f"{sf_dir}/events.parquet"))


def queries() -> dict:
    return {"window_tumbling": tumbling}


def oracle_sql() -> dict[str, str]:
    return {"window_tumbling": "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, event_type, COUNT(*) AS n FROM events GROUP BY 1, 2"}
