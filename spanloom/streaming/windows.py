"""Sliding windows over a stream of spans (event_time, media_id, t0, t1, text, speaker)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Chunks of 2 s that overlap by 0.5 s; events may come up to 3 s late.
LENGTH, STEP, LATE = "2 seconds", "1500 milliseconds", "3 seconds"


def window_counts(stream: DataFrame, length: str = LENGTH, step: str = STEP, late: str = LATE) -> DataFrame:
    """Spans, speakers and covered seconds of each media and window; rows later than the watermark are dropped by Spark."""
    w = F.window("event_time", length, step)
    return (
        stream.withWatermark("event_time", late).groupBy("media_id", w)
        .agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("speaker").alias("speakers"), F.sum(F.col("t1") - F.col("t0")).alias("seconds"))
        .select("media_id", F.col("window.start").alias("from"), F.col("window.end").alias("to"), "n", "speakers", "seconds")
    )


def without_repeats(stream: DataFrame, late: str = LATE) -> DataFrame:
    """Spans that overlapping chunks deliver twice, once: same media, 50 ms cell of the start, and text."""
    cell = F.floor(F.col("t0") / 0.05).cast("long")
    return stream.withColumn("_cell", cell).withWatermark("event_time", late).dropDuplicatesWithinWatermark(["media_id", "_cell", "text"]).drop("_cell")
