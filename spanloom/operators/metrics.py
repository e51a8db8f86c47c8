"""Timeline error statistics, outliers, drift and ranking."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def percentile(c: str, q: float) -> Column:
    return F.percentile(c, F.lit(q))


def error_report(pairs: DataFrame, by: Sequence[str], gold: str, got: str) -> DataFrame:
    """Matched, missing and extra rows and absolute error statistics for a full outer pairing."""
    err = F.abs(F.col(got) - F.col(gold))
    return pairs.withColumn("_e", err).groupBy(*by).agg(
        F.count("_e").alias("matched"), F.count_if(F.col(got).isNull()).alias("missing"), F.count_if(F.col(gold).isNull()).alias("extra"),
        F.avg("_e").alias("mae"), percentile("_e", 0.5).alias("median"), percentile("_e", 0.95).alias("p95"),
    )


def iqr_outliers(df: DataFrame, by: Sequence[str], value: str, k: float = 1.5) -> DataFrame:
    ends = df.groupBy(*by).agg(percentile(value, 0.25).alias("q1"), percentile(value, 0.75).alias("q3"))
    return df.join(ends, [*by]).where((F.col(value) < F.col("q1") - k * (F.col("q3") - F.col("q1"))) | (F.col(value) > F.col("q3") + k * (F.col("q3") - F.col("q1"))))


def direction_flips(df: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """How often the value's change turns its sign from row to row; unchanged steps are passed over."""
    w = W.partitionBy(*by).orderBy(order)
    steps = df.withColumn("_s", F.signum(F.col(value) - F.lag(value).over(w))).where("_s <> 0")
    turned = steps.withColumn("_f", (F.col("_s") != F.lag("_s").over(w)).cast("int"))
    return turned.groupBy(*by).agg(F.coalesce(F.sum("_f"), F.lit(0)).alias("flips"), F.count(F.lit(1)).alias("steps"))


def decayed(df: DataFrame, by: Sequence[str], time: str, value: str, half_life: float) -> DataFrame:
    """Mean of the values weighted by half-lives before the key's last time."""
    last = df.groupBy(*by).agg(F.max(time).alias("_last"))
    w = F.pow(F.lit(0.5), (F.col("_last") - F.col(time)) / half_life)
    return df.join(last, [*by]).groupBy(*by).agg((F.sum(w * F.col(value)) / F.sum(w)).alias("decayed"), F.count(F.lit(1)).alias("n"))


def top_per(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    return df.withColumn(name, F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col(name) <= k)
