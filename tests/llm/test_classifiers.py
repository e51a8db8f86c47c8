import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from spanloom.llm import langid, quality

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")


def test_language_held_out(real):
    docs, _ = real
    truth = {r.doc_id: r.lang for r in docs.collect()}
    got = langid.identify(docs).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.98 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_code_switched_words(real):
    model = langid.fit(real[0])
    words, post = model.word_marginals(["the and with that from nicht und die auch sich"])
    labels = [model.names[i] for i in post.argmax(axis=1)]
    assert labels == ["en"] * 5 + ["de"] * 5 and words.counts.tolist() == [10]


def test_language_odd(odd_docs, no_docs):
    got = {r.doc_id: r for r in langid.identify(odd_docs).collect()}
    assert len(got) == odd_docs.select("doc_id").distinct().count()
    for i in (1, 2, 7, 13):
        assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
    assert langid.identify(no_docs).count() == 0
    assert {r.lang_pred for r in langid.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_quality_held_out(real):
    docs, labels = real
    truth = {r.doc_id: r.quality for r in labels.collect()}
    got = quality.score(docs, labels).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_quality_odd(spark, odd_docs, no_docs, real):
    labels = spark.createDataFrame([(3, 1, 0), (5, 1, 0), (8, 0, 0), (13, 0, 0), (9, 0, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.score(odd_docs, labels).collect()
    assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in quality.score(odd_docs, labels.limit(0)).collect()} == {0.5}
    assert {r.predicted for r in quality.score(odd_docs, labels.where("quality = 1")).collect()} == {1}
    assert quality.score(no_docs, real[1]).count() == 0
    assert quality.keep_good(odd_docs, labels.limit(0)).columns == odd_docs.columns


def test_sample_is_of_labelled_documents(spark, real):
    docs, labels = real
    absent = spark.range(10**6, 10**6 + 40_000).select(F.col("id").alias("doc_id"), F.lit(1).alias("quality"), F.lit(0).alias("toxic"))
    model = quality.fit(docs, labels.select("doc_id", F.col("quality").cast("int"), F.col("toxic").cast("int")).unionByName(absent))
    assert isinstance(model, quality.LineField)
    # lines of a document put together from a good and a bad one go with their own part
    kind = {v: [r.text for r in docs.join(labels, "doc_id").where(f"quality = {v} and crc32(cast(doc_id as string)) % 3 = 1").orderBy("doc_id").collect()] for v in (0, 1)}
    right = total = 0
    for a, b in zip(kind[1], kind[0], strict=False):
        features, counts, weight = quality.line_features([f"{a}\n{b}"])
        good = model.line_marginals(features, counts)[:, 1] >= 0.5
        right += weight[good == (np.arange(len(good)) <= a.count("\n"))].sum()
        total += weight.sum()
    assert total and right >= 0.95 * total


def test_any_id_type_and_clashing_names(odd_docs, spark):
    labels = spark.createDataFrame([("3", 1), ("5", 1), ("8", 0), ("13", 0)], "doc_id string, quality int")
    docs = odd_docs.withColumn("doc_id", F.col("doc_id").cast("string")).withColumn("score", F.lit("mine")).withColumn("label", F.lit(3))
    assert quality.score(docs, labels).count() == docs.count() and langid.identify(docs).count() == docs.count()
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and {r.score for r in kept.collect()} <= {"mine"}


def test_lines_take_the_other_label_up_to_half():
    post = np.array([[0.01, 0.99], [0.99, 0.01], [0.98, 0.02], [0.5, 0.5], [0.3, 0.7], [0.01, 0.99]])
    out = quality.relabelled(post, np.array([4, 2]), np.array([5.0, 3.0, 3.0, 5.0, 9.0, 2.0]), np.array([1, 0]))
    assert out.tolist() == [1, 0, 0, 1, 0, 1]


def test_long_texts(spark):
    text = "the quick brown fox jumps over the lazy dog and " * 120_000
    docs = spark.createDataFrame([(1, text, "en"), (2, "und der die das nicht " * 9, "de"), (3, "the and of with that " * 9, "en"), (4, "x\n" * 300_000, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(2, 1), (3, 0)], "doc_id long, quality int")
    assert quality.score(docs, labels).count() == 4 and langid.identify(docs).count() == 4
