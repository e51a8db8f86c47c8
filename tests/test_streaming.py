from pyspark.sql import functions as F

from spanloom.streaming import merging as G
from spanloom.streaming import windows as S

SCHEMA = "event_time timestamp, media_id string, t0 double, t1 double, text string, speaker string"


def feed(spark, path):
    rows = [(1.0, "a", 1.0, 1.5, "x", "s1"), (1.6, "a", 1.6, 1.9, "y", "s2"), (1.6, "a", 1.6, 1.9, "y", "s2"), (1.0, "b", 1.0, 1.2, "x", "s1")]
    df = spark.createDataFrame([(*r,) for r in rows], "s double, media_id string, t0 double, t1 double, text string, speaker string")
    df.select(F.timestamp_seconds("s").alias("event_time"), "media_id", "t0", "t1", "text", "speaker").write.parquet(path)
    return spark.readStream.schema(SCHEMA).parquet(path)


def finish(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(60)
    return stream.sparkSession.table(name)


def test_windows(spark, tmp_path):
    got = finish(S.window_counts(feed(spark, str(tmp_path / "in"))), "windows", "complete")
    rows = {(r.media_id, r["from"].timestamp()): (r.n, r.speakers) for r in got.collect()}
    assert rows == {("a", 0.0): (3, 2), ("a", 1.5): (2, 1), ("b", 0.0): (1, 1)}


def test_repeats(spark, tmp_path):
    got = finish(S.without_repeats(feed(spark, str(tmp_path / "in"))), "once", "append")
    assert sorted((r.media_id, r.text) for r in got.collect()) == [("a", "x"), ("a", "y"), ("b", "x")]


def test_buffer_rules():
    cue = lambda t0, t1, text, who="a": {"t0": t0, "t1": t1, "text": text, "speaker": who}
    assert G.joins(cue(0, 1, "x"), cue(1.05, 2, "y", "b"))  # very near
    assert not G.joins(cue(0, 1, "x"), cue(1.9, 2, "y"))  # far
    assert not G.joins(cue(0, 1, "x"), cue(1.2, 2, "y", "b"))  # speakers differ
    assert G.joins(cue(0, 1, "x,"), cue(1.7, 2, "y", "unknown"))  # goes on
    assert not G.joins(cue(0, 1, "x."), cue(1.2, 2, "y"))  # ended
    assert G.joins(cue(0, 1, "x"), cue(1.2, 2, "y"), lambda a, b: 0.9)
    assert not G.joins(cue(0, 1, "x"), cue(1.2, 2, "y"))
    assert G.joins(cue(0, 1, "x"), cue(1.13, 2, "y"))


def test_merge_stream(spark, tmp_path):
    rows = [(1.0, "a", 1.0, 1.5, "one", "s"), (1.6, "a", 1.55, 1.9, "two", "s"), (3.0, "a", 3.0, 3.5, "three.", "s"), (5.0, "a", 5.0, 5.5, "four", "s"), (1.0, "b", 1.0, 1.2, "x", "s")]
    df = spark.createDataFrame(rows, "s double, media_id string, t0 double, t1 double, text string, speaker string")
    df.select(F.timestamp_seconds("s").alias("event_time"), "media_id", "t0", "t1", "text", "speaker").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    got = finish(G.merge_stream(stream), "merged", "append")
    rows = sorted((r.media_id, r.t0, r.t1, r.text) for r in got.collect())
    assert ("a", 1.0, 1.9, "one two") in rows
    assert all(r[3] != "one" for r in rows)
