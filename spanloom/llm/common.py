"""Helpers shared by the corpus operators.

Staged tables are Parquet files in the folder that ``spark.checkpoint.dir`` names, so every executor
can read them again and a lost executor costs only the tasks it was running.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

#: ASCII white space separates words; every other code point belongs to a word.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of a group are ranked in parallel buckets, this many or one for so many rows.
RANK_BUCKETS, RANK_ROWS = 128, 500_000
#: Rows of one or two numbers (20 bytes at most) up to which a list of them is broadcast.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; a folder of this machine only where the session names none and runs on it alone, as in tests."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if sc.getCheckpointDir() is None and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="spanloom-"))
    return sc.getCheckpointDir().rstrip("/")


#: Folders staged inside this thread's open ``scratch`` blocks, the innermost last.
_scratch = threading.local()


def stage(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage and fixes its rows. ``lasting``: it outlives the ``scratch`` block."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if getattr(_scratch, "open", None) and not lasting:
        _scratch.open[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables staged inside are deleted at the end; what is needed later must be staged as lasting."""
    _scratch.open = [*getattr(_scratch, "open", ()), []]
    try:
        yield
    finally:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for name in _scratch.open.pop():
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def own_name(name: str, *dfs: DataFrame) -> str:
    """``name`` with as many underscores before it as it takes to be no column of ``dfs``, whatever the case."""
    taken = {c.lower() for df in dfs for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def listed(ids: DataFrame) -> DataFrame:
    """A staged list of numbers, broadcast where it has BROADCAST_ROWS rows or fewer."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids


def words_in(text: Column) -> Column:
    """Number of words of the whole text; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(batches: Iterator[pa.RecordBatch], column: str, budget: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that ``column`` holds about ``budget`` bytes at most (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        col = batch.column(batch.schema.get_field_index(column))
        sizes = pa.compute.binary_length(col).to_pylist()
        start, total = 0, 0
        for i, n in enumerate(sizes):
            if i > start and total + (n or 0) > budget:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n or 0
        yield batch.slice(start)


def ranked(df: DataFrame, by: list[str], order: list[str], name: str) -> DataFrame:
    """Add ``name``: gapless positions from 0 within each group ``by``, in a seeded order of ``order``.

    The rows of a group are dealt to hash buckets, counted, and numbered inside their bucket; there is one bucket for
    RANK_ROWS rows of the table, RANK_BUCKETS at least, so a group that holds most of it still spreads. Rows that agree in
    ``order`` are interchangeable and share a bucket. ``df`` is evaluated again: pass a staged table.
    """
    buckets = max(RANK_BUCKETS, df.count() // RANK_ROWS)
    bucket, inner, n, offset = (own_name(x, df) for x in ("_rb", "_in", "_n", "_off"))
    keyed = df.withColumn(bucket, F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int"))
    keys = [*by, bucket]
    counts = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias(n))
    before = W.partitionBy(*by).orderBy(bucket).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.withColumn(offset, F.coalesce(F.sum(n).over(before), F.lit(0)))
    theirs = [own_name(f"_o{i}", df) for i in range(len(keys))]
    offsets = offsets.select(*[F.col(k).alias(t) for k, t in zip(keys, theirs, strict=True)], offset)
    on = [F.col(k).eqNullSafe(F.col(t)) for k, t in zip(keys, theirs, strict=True)]
    inside = F.row_number().over(W.partitionBy(*keys).orderBy(F.xxhash64(*order, F.lit(7)), *order))
    joined = keyed.withColumn(inner, inside).join(offsets, on)
    return joined.withColumn(name, (F.col(offset) + F.col(inner) - 1).cast("long")).drop(bucket, inner, offset, *theirs)


def ordinals(df: DataFrame, column: str) -> DataFrame:
    """(value, ordinal): the place from 0 of each distinct value of a column in ascending order, without null."""
    values = df.select(F.col(column).alias("value")).where("value is not null").distinct()
    sorted_ = values.repartitionByRange("value").sortWithinPartitions("value").withColumn("id", F.monotonically_increasing_id())
    held = stage(sorted_.select("value", F.shiftright("id", 33).cast("int").alias("part"), F.col("id").bitwiseAND(F.lit((1 << 33) - 1)).alias("at")), "ordinals")
    start, before = {}, 0
    for r in sorted(held.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()):  # one row a partition
        start[r.part], before = before, before + r.n
    if not start:
        return held.select("value", F.col("at").alias("ordinal"))
    offset = F.create_map(*[F.lit(x) for pair in start.items() for x in pair])
    return held.select("value", (F.element_at(offset, F.col("part")) + F.col("at")).cast("long").alias("ordinal"))


def crc32_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null ids count as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def schema_of(df: DataFrame, **added: T.DataType) -> T.StructType:
    fields = [f for f in df.schema.fields if f.name not in added]
    return T.StructType(fields + [T.StructField(k, v) for k, v in added.items()])
