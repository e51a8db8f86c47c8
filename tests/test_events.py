import numpy as np
from pyspark.sql import functions as F

from spanloom.functions import events as ev
from spanloom.operators import events as op
from spanloom.operators import intervals as iv


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(n) for n, c in columns.items()]).first().asDict()


def test_covariance_distance_against_numpy(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id int, v array<double>").repartition(3)
    fitted = op.CovarianceDistance.fit(df, "v", 5)
    z = (x - x.mean(axis=0)) / x.std(axis=0)
    inverse = np.linalg.inv(np.cov(z.T) + 1e-6 * np.eye(5))
    got = {r.id: r.distance for r in fitted.add_distance(df, "v").collect()}
    assert all(abs(got[i] - np.sqrt(z[i] @ inverse @ z[i])) < 1e-6 for i in got)
    pairs = df.withColumn("w", F.array(*[F.lit(float(c)) for c in x[3]]))
    assert abs(next(r.distance for r in fitted.add_distance(pairs, "v", "w").collect() if r.id == 3)) < 1e-9
    assert op.CovarianceDistance.fit(df.limit(1), "v", 5) is None


def test_edges_of_rules(spark):
    none = F.array().cast("array<struct<start:double,end:double,clip:string>>")
    span = lambda a, b, c: F.array(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(c).alias("clip")))
    region = F.lit(None).cast("int")
    got = one(
        spark, both=ev.owners_agree(none, none, region, region), left=ev.owners_agree(span(0.0, 1.0, "a"), none, region, region), meet=ev.owners_agree(span(0.0, 1.0, "a"), span(1.01, 2.0, "a"), region, region),
        apart=ev.owners_agree(span(0.0, 1.0, "a"), span(1.5, 2.0, "a"), region, region), other=ev.owners_agree(span(0.0, 1.0, "a"), span(1.0, 2.0, "b"), region, region), regions=ev.owners_agree(none, none, F.lit(1), region),
        hard=ev.warnings_agree(F.lit("x;hard_split"), F.lit(None).cast("string"), F.lit(False), F.lit(None).cast("boolean")), soft=ev.warnings_agree(F.lit("x"), F.lit(None).cast("string"), F.lit(None).cast("boolean"), F.lit(False)),
        empty=ev.clamped(F.lit(5.0), F.lit(9.0), F.lit(4.0)), before=ev.to_local(F.lit(1.0), F.lit(2.0)), short=ev.doubtful_stop(F.lit("no it is very.")), loose=ev.doubtful_stop(F.lit("that one was quite very.")), silent=ev.surge(F.lit(0.0), F.lit(1.0)),
    )
    assert got == {
        "both": True, "left": False, "meet": True, "apart": False, "other": False, "regions": False, "hard": False, "soft": True, "empty": None, "before": None, "short": False, "loose": True, "silent": 0.15
    }


def test_semi_and_anti_with_repeated_and_null_ids(spark):
    left = spark.createDataFrame([(1, 1, 0.0, 1.0), (1, 1, 8.0, 9.0), (None, 1, 0.5, 0.6), (None, 1, 5.0, 6.0)], "id int, m int, t0 double, t1 double")
    right = spark.createDataFrame([(7, 1, 0.0, 2.0)], "id int, m int, t0 double, t1 double")
    assert sorted(r.t0 for r in iv.overlap_exists(left, right, ["m"], 1.0).collect()) == [0.0, 0.5]
    assert sorted(r.t0 for r in iv.overlap_exists(left, right, ["m"], 1.0, anti=True).collect()) == [5.0, 8.0]


def test_semi_and_anti_on_shuffled_rows(spark):
    """Rows behind a shuffle or an aggregate come in another order each time they are read."""
    rows = spark.range(20_000).select(F.col("id"), (F.col("id") % 7).alias("m"), (F.col("id") * 10.0).alias("t0"), (F.col("id") * 10.0 + 1).alias("t1"))
    right = spark.range(200).select(((F.col("id") * 97) % 7).alias("m"), (F.col("id") * 970.0).alias("t0"), (F.col("id") * 970.0 + 0.5).alias("t1"))
    want = {97 * i for i in range(200)}
    for left in (rows.repartition(16), rows.groupBy("id", "m", "t0").agg(F.max("t1").alias("t1")).repartition(5)):
        assert {r.id for r in iv.overlap_exists(left, right, ["m"], 50.0).collect()} == want
        got = [r.id for r in iv.overlap_exists(left, right, ["m"], 50.0, anti=True).collect()]
        assert len(got) == 19_800 and not want & set(got)
