"""Corpus pipeline: quality, exact dedup, near-dedup, mixing and packing, each over all that the stage before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import exact_dedup, mixing, packing, quality, simhash
from spanloom.llm.common import listed, shared_dir, stage, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line field does not reject."""
    return quality.keep_good(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text, the one with the largest doc_id."""
    return exact_dedup.drop_exact(docs.select(*COLUMNS))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more on five-word shingles, the one with the smallest doc_id."""
    return simhash.drop_near(docs.select(*COLUMNS))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the choice among documents of one size goes by doc_id and text."""
    held = stage(docs.select(*COLUMNS).withColumn("_row", F.monotonically_increasing_id()).withColumn("_code", F.xxhash64("text")), "mix-docs")
    taken = mixing.mix(held, keep=("_row", "doc_id", "_code"), order=("doc_id", "_code")).where("copies > 0").select("_row", "copies")
    taken = listed(stage(taken, "mix-taken"))
    return held.join(taken, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Place of every document: its length bucket, batch and slot."""
    return packing.pack(docs, keep=("doc_id", "source")).select("doc_id", "source", "n_tokens", "bucket", "bucket_tokens", "batch", "slot")


STAGES = [("quality", good), ("exact dedup", exact), ("near dedup", near), ("mixing", mixed), ("packing", packed)]
#: The first stage is a trained model, which SQL cannot express; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        path = f"{shared_dir(spark)}/pipeline-{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        step(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
