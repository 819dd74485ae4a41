"""Unbounded sources over landing folders; a message bus is a change of format and options."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WATERMARK = "60 seconds"


def packet_stream(spark: SparkSession, folder: str, schema: T.StructType, max_files: int | None = None,
                  watermark: str = WATERMARK, origin: float = 0.0) -> DataFrame:
    """Packets from a landing folder with event time ``ts`` and a watermark."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return with_event_time(reader.parquet(folder), watermark, origin)


def with_event_time(stream: DataFrame, watermark: str = WATERMARK, origin: float = 0.0) -> DataFrame:
    """``origin`` is the epoch time of second 0 for clocks that start at 0: a watermark begins at
    the epoch, and rows not after it count as late."""
    return stream.withColumn("ts", F.timestamp_micros(((F.col("ts_s") + origin) * 1_000_000).cast("bigint"))).withWatermark("ts", watermark)


def alert_lines(spark: SparkSession, folder: str) -> DataFrame:
    """New lines of the alert log. The text source starts where its checkpoint ended, so lines
    are neither skipped nor read twice. Each line is ``event_no <tab> ts_s <tab> json``."""
    parts = F.split("value", "\t", 3)
    return spark.readStream.text(folder).select(
        parts[0].try_cast("bigint").alias("event_no"), parts[1].try_cast("double").alias("ts_s"), parts[2].alias("line"))
