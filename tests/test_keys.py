import json

import pytest
from pyspark.sql import functions as F

from spanloom.functions import keys as K
from spanloom.sources.cache import Cache


def test_equal_records_have_one_form(spark):
    texts = ['{"b": 1, "a": {"y": [1, 2], "x": null}}', '{"a":{"x":null,"y":[1,2]},"b":1}', ' { "a" : {"y":[1,2] , "x":null}, "b":1 } ', '{"a":{"x":null,"y":[2,1]},"b":1}', '{"é":"天\\n"}']
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", K.canonical_json(F.col("t")).alias("c"), K.fingerprint(F.col("t")).alias("f"))
    got = {r.t: r for r in df.collect()}
    assert all(got[t].c == json.dumps(json.loads(t), sort_keys=True, separators=(",", ":"), ensure_ascii=False) for t in texts)
    assert len({got[t].f for t in texts[:3]}) == 1 and len({r.f for r in got.values()}) == 3
    for wrong in ('{"a":1,"a":2}', '{"a":NaN}', "{"):
        with pytest.raises(Exception, match="(?i)malformed|duplicate"):
            spark.range(1).select(K.canonical_json(F.lit(wrong))).collect()


def test_result_keys(spark):
    a, b = F.lit("x"), F.lit("y")
    ask = lambda *args: spark.range(1).select(K.result_key(*args)).first()[0]
    null = F.lit(None).cast("double")
    assert ask({"a": a, "b": b}, null) == ask({"b": b, "a": a}, null) != ask({"a": b, "b": a}, null)
    assert ask({"a": a}, F.lit(1)) == ask({"a": a}, F.lit(1.0)) != ask({"a": a}, null) and ask({"a": a}, null, {"n": F.lit(1)}) != ask({"a": a}, null)
    for fields, duration in (({"a": F.lit(" ")}, null), ({"a": F.lit(None).cast("string")}, null), ({"a": a}, F.lit(-1.0)), ({"a": a}, F.lit(float("inf"))), ({"a": a}, F.lit(float("nan")))):
        with pytest.raises(Exception, match="not blank"):
            ask(fields, duration)
    with pytest.raises(ValueError):
        K.result_key({"a": a}, null, {"api_Token": b})


def test_cache_expires(spark, tmp_path):
    c = Cache(spark, str(tmp_path / "cache"), {"short": 10.0})
    kv = lambda *rows: spark.createDataFrame(rows, "key string, value string")
    keys = spark.createDataFrame([("a",), ("b",), ("zz",)], "key string")
    got = lambda stage, now: {r.key: r.value for r in c.get(keys, stage, now).collect()}
    assert got("short", 0.0) == {"a": None, "b": None, "zz": None}
    c.put(kv(("a", "1"), ("b", "2")), "short", 0.0)
    c.put(kv(("a", "other")), "long", 0.0)
    c.put(kv(("b", "3")), "short", 5.0, lasts=100.0)
    assert got("short", 10.0) == {"a": "1", "b": "3", "zz": None} and got("short", 10.5) == {"a": None, "b": "3", "zz": None} and got("long", 80_000.0)["a"] == "other"
    c.clear_expired(50.0)
    assert {(r.stage, r.key) for r in c.rows.read().collect()} == {("short", "b"), ("long", "a")}
    c.delete("short", keys.where("key = 'b'"))
    c.delete("none")
    assert [(r.stage, r.key) for r in c.rows.read().collect()] == [("long", "a")]
