"""Results kept by stage and key until they expire, in a versioned table that all executors share."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .history import History

SCHEMA = "stage string, key string, value string, expires double"
DAY = 86_400.0


class Cache:
    """Values by (stage, key). A value counts until its time is past; ``lasts`` has the seconds that values of a stage last (a day for others)."""

    def __init__(self, spark: SparkSession, path: str, lasts: Mapping[str, float] | None = None):
        self.rows, self.lasts = History(spark, path, SCHEMA, ["stage", "key"]), dict(lasts or {})

    def put(self, values: DataFrame, stage: str, now: float, lasts: float | None = None) -> None:
        """Store (key, value) rows; known keys get the new value and time."""
        until = now + (lasts if lasts is not None else self.lasts.get(stage, DAY))
        self.rows.upsert(values.select(F.lit(stage).alias("stage"), "key", "value", F.lit(until).alias("expires")))

    def get(self, keys: DataFrame, stage: str, now: float) -> DataFrame:
        """``keys`` (key) with ``value``: null where none is stored or it has expired."""
        live = self.rows.read().where((F.col("stage") == stage) & (F.col("expires") >= now)).select("key", "value")
        return keys.join(live, "key", "left")

    def delete(self, stage: str, keys: DataFrame | None = None) -> None:
        """Remove a stage, or some keys of it."""
        if keys is None:
            return self.rows.delete(F.col("stage") == stage)
        kept = self.rows.read().join(keys.select(F.lit(stage).alias("stage"), "key"), ["stage", "key"], "left_anti")
        return self.rows._commit(kept)

    def clear_expired(self, now: float) -> None:
        self.rows.delete(F.col("expires") < now)
