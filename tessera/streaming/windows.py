"""Event streams as windowed series, for forecasts and drift of coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_series(events: DataFrame, width: str = "1 hour", late: str = "10 minutes", time: str = "ts") -> DataFrame:
    """series_id (event type), t (start of the window), value (sum) of a batch or a stream with a watermark."""
    stamped = events.withColumn(time, F.col(time).cast("timestamp"))
    stamped = stamped.withWatermark(time, late) if events.isStreaming else stamped
    return stamped.groupBy(F.window(time, width), F.col("event_type").alias("series_id")).agg(F.sum("value").alias("value")).select("series_id", F.col("window.start").alias("t"), "value")
