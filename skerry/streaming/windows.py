"""Event-time windows that read alike from a batch and from a stream (beyond parity)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(events: DataFrame, time: str, width: str, keys: Sequence[str], late: str = "1 hour") -> DataFrame:
    """Rows for each window and key; a stream gets a watermark, so its state stays bounded."""
    events = events.withColumn("_t", F.col(time).cast("timestamp"))
    if events.isStreaming:
        events = events.withWatermark("_t", late)
    counted = events.groupBy(F.window("_t", width).alias("_w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(*keys, F.col("_w.start").cast("timestamp_ntz").alias("start"), "n")
