"""Incremental deduplication of a stream of texts, an extension to the batch operators."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def first_seen(stream: DataFrame, text: str, time: str, delay: str = "1 day") -> DataFrame:
    """Rows whose text hash has not come within ``delay`` of event time; state older than the watermark is dropped."""
    hashed = stream.withColumn("_hash", F.sha2(F.col(text), 256)).withWatermark(time, delay)
    return hashed.dropDuplicatesWithinWatermark(["_hash"]).drop("_hash")


def windowed_counts(stream: DataFrame, time: str, group: str, window: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """Rows per group and window of event time; late rows within ``delay`` still count."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window).alias("window"), group).agg(F.count("*").alias("rows"))
