"""Running score summaries over a stream of score files (an addition: the analyses themselves are batch jobs)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def windowed_means(events: DataFrame, time: str = "ts", key: str = "event_type", value: str = "value", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, key, n, mean) by tumbling event-time window; rows later than the watermark are dropped. Batch or stream."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = timed.groupBy(F.window(time, width), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), key, "n", "mean")


def upsert(batch: DataFrame, path: str, keys: list[str]) -> None:
    """foreachBatch sink: appends rows whose keys are new, so that a batch that is run again adds nothing."""
    from ..sources.writers import append_new

    append_new(batch, path, keys)
