"""The list of named queries and the SQL that each is held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import spans

M = ["media_id"]
HOUR = 3600.0
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

SPANS = """s AS (SELECT event_id AS id, user_id AS media_id, event_type AS speaker, epoch_us(ts) / CAST(1000000 AS DOUBLE) AS t0,
    epoch_us(ts) / CAST(1000000 AS DOUBLE) + value * 60 AS t1, value FROM events)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql.replace("{S}", SPANS)
        return f

    return add


def _ms(*names: str):
    return [F.round(F.col(n) * 1000).cast("long").alias(n + "_ms") for n in names]


def _of(spark, d, kind, negate=False):
    s = spans(spark, d)
    return s.where(F.col("speaker") != kind) if negate else s.where(F.col("speaker") == kind)


MS = "CAST(round({0} * 1000) AS BIGINT) AS {0}_ms"
