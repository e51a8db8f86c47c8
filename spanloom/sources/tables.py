"""Views of the driver's tables as the tables of the interval model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, media_id, speaker, t0, t1 in seconds: an event lasts `value` minutes from its time."""
    t0 = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"), F.col("user_id").alias("media_id"), F.col("event_type").alias("speaker"), t0.alias("t0"), (t0 + F.col("value") * 60).alias("t1"), "value"
    )
