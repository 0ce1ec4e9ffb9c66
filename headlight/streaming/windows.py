"""Streaming twin of the rate limit: counts per client and tumbling window, with a watermark for late events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def client_counts(events: DataFrame, client: str, ts: str, limit: int = 20, window: str = "60 seconds", late: str = "5 minutes") -> DataFrame:
    """events may be a stream or a table: requests, accepted and rejected per client and window."""
    d = events.withColumn(ts, F.col(ts).cast("timestamp"))
    d = (d.withWatermark(ts, late) if d.isStreaming else d).groupBy(client, F.window(ts, window)["start"].alias("slot_start")).agg(F.count("*").alias("requests"))
    return d.withColumns({"accepted": F.least("requests", F.lit(limit)), "rejected": F.greatest(F.lit(0), F.col("requests") - limit)})
