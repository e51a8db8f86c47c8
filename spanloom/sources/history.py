"""Keyed tables with updates, kept as numbered Parquet versions.

A change writes the next version whole and then a marker with its number; readers take the highest marked version, so a
lost executor or driver leaves the last one valid. One writer at a time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


class History:
    """A table at ``path`` with the primary key ``key``; ``keep`` old versions stay for rollback."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: Sequence[str]):
        self.spark, self.path, self.schema, self.key = spark, path.rstrip("/"), schema, list(key)

    def versions(self) -> list[int]:
        try:
            marks = self.spark.read.schema("version long").parquet(f"{self.path}/marks")
        except AnalysisException:  # no version yet
            return []
        return sorted(r.version for r in marks.distinct().collect())

    def read(self, back: int = 0) -> DataFrame:
        """The newest version, or the one ``back`` versions before it."""
        known = self.versions()
        if len(known) <= back:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.path}/v{known[-1 - back]}")

    def _commit(self, df: DataFrame) -> None:
        n = max(self.versions(), default=-1) + 1
        names = [f.name for f in self.read().schema]
        df.select(*names).write.mode("overwrite").parquet(f"{self.path}/v{n}")
        self.spark.range(n, n + 1, 1, 1).withColumnRenamed("id", "version").write.mode("append").parquet(f"{self.path}/marks")

    def upsert(self, rows: DataFrame) -> None:
        """Replace rows of equal key and append the others; of repeated keys in ``rows`` one row counts."""
        self._commit(self.read().join(rows.select(*self.key), self.key, "left_anti").unionByName(rows.dropDuplicates(self.key)))

    def count_up(self, rows: DataFrame, counter: str) -> None:
        """Insert rows with ``counter`` 1; where the key is known, replace them and add 1 to the counter."""
        old = self.read().select(*self.key, F.col(counter).alias("_c"))
        fresh = rows.dropDuplicates(self.key).drop(counter).join(old, self.key, "left").withColumn(counter, (F.coalesce("_c", F.lit(0)) + 1).cast("long")).drop("_c")
        self.upsert(fresh)

    def update(self, where: Column, **values: Column) -> None:
        self._commit(self.read().withColumns({c: F.when(where, v).otherwise(F.col(c)) for c, v in values.items()}))

    def delete(self, where: Column) -> None:
        """Remove rows that meet the condition; rows for which it is null stay."""
        self._commit(self.read().where(~F.coalesce(where, F.lit(False))))

    def rollback(self) -> None:
        """The version before the newest becomes the newest again."""
        self._commit(self.read(back=1))

    def page(self, order: str, limit: int, offset: int = 0, where: Column | None = None) -> DataFrame:
        df = self.read() if where is None else self.read().where(where)
        return df.orderBy(F.desc(order), *self.key).offset(offset).limit(limit)

    def newest(self, by: Sequence[str], order: str, where: Column) -> DataFrame:
        """The newest row of each ``by`` that meets ``where``."""
        w = W.partitionBy(*by).orderBy(F.desc(order), *self.key)
        return self.read().where(where).withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")
