"""Queries for frame operators and grouped kernels; an event stands in for a frame with its value as energy."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import frames as fr
from ..operators import kernels as kn
from ..operators import spectrum as su
from ..sources.tables import spans, table
from .registry import HOUR, M, _of, query

FRAMES = "f AS (SELECT media_id, id, t0, t1, value AS rms, row_number() OVER (PARTITION BY media_id ORDER BY t0, t1, id) - 1 AS k FROM s)"


def frames(spark, d):
    k = F.row_number().over(W.partitionBy("media_id").orderBy("t0", "t1", "id")) - 1
    return spans(spark, d).select("media_id", "id", "t0", "t1", F.col("value").alias("rms"), k.cast("long").alias("k"))


@query("WITH {S}, " + FRAMES + """, q AS (SELECT media_id, k, k - row_number() OVER (PARTITION BY media_id ORDER BY k) AS r FROM f WHERE rms < 5)
SELECT media_id, min(k) AS k0, max(k) AS k1, count(*) AS frames FROM q GROUP BY media_id, r HAVING count(*) >= 3""")
def quiet_runs(spark, d):
    return fr.runs_where(frames(spark, d), M, F.col("rms") < 5, 3).select("media_id", "k0", "k1", "frames")


@query("WITH {S}, " + FRAMES + """, l AS (SELECT media_id, k, CASE WHEN k - lag(k) OVER (PARTITION BY media_id ORDER BY k) - 1 >= 3 THEN 1 ELSE 0 END AS n FROM f WHERE rms > 12),
r AS (SELECT *, sum(n) OVER (PARTITION BY media_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS r FROM l) SELECT media_id, min(k) AS k0, max(k) AS k1 FROM r GROUP BY media_id, r HAVING max(k) - min(k) + 1 >= 2""")
def voiced_runs(spark, d):
    return fr.voiced(frames(spark, d), M, 12.0, 3, 2).select("media_id", "k0", "k1")


@query("WITH {S}, " + FRAMES + """, r AS (SELECT media_id, rms, row_number() OVER (PARTITION BY media_id ORDER BY rms) - 1 AS n, count(*) OVER (PARTITION BY media_id) AS c FROM f WHERE k % 5 = 0)
SELECT media_id, greatest(rms, CAST(1 AS DOUBLE)) AS floor FROM r WHERE n = floor(c * CAST(0.2 AS DOUBLE))""")
def noise_floor(spark, d):
    return fr.noise_floor(frames(spark, d), M, 0.2, 5, 1.0)


@query("WITH {S}, " + FRAMES + """, g AS (SELECT id, media_id, k - 4 AS k0, k + 4 AS k1 FROM f WHERE rms > 20)
SELECT g.id, arg_min(f.k, struct_pack(a := f.rms, b := f.k)) AS at, min(f.rms) AS rms FROM g JOIN f ON f.media_id = g.media_id AND f.k BETWEEN k0 AND k1 GROUP BY g.id""")
def quietest_near(spark, d):
    f = frames(spark, d)
    ranges = f.where("rms > 20").select("id", "media_id", (F.col("k") - 4).alias("k0"), (F.col("k") + 4).alias("k1"))
    return fr.quietest(f, ranges, M, 32)


@query("WITH {S}, " + FRAMES + """, e AS (SELECT id, avg(rms) OVER (PARTITION BY media_id ORDER BY k ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) / greatest(avg(rms) OVER (PARTITION BY media_id ORDER BY k ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), CAST(1e-10 AS DOUBLE)) AS ratio FROM f),
n AS (SELECT id, min(k) = 0 AS head FROM f GROUP BY id)
SELECT id, CASE WHEN head THEN NULL ELSE round(ratio, 6) END AS ratio, CAST(CASE WHEN head THEN 0.2 WHEN ratio > 8 THEN 0.05 WHEN ratio > 3 THEN 0.1 WHEN ratio > 1.5 THEN 0.15 ELSE 0.2 END AS DOUBLE) AS pad FROM e JOIN n USING (id)""")
def edge_padding(spark, d):
    e = fr.edge_ratio(frames(spark, d), M)
    head = F.col("k") == 0
    return e.select("id", F.when(~head, F.round("ratio", 6)).alias("ratio"), fr.pad_by_slope(F.when(~head, F.col("ratio"))).alias("pad"))


@query("WITH {S}, " + FRAMES + """, m AS (SELECT media_id, k, rms, quantile_cont(rms, 0.5) OVER (PARTITION BY media_id ORDER BY k ROWS BETWEEN 10 PRECEDING AND 10 FOLLOWING) AS m FROM f),
q AS (SELECT media_id, k, k - row_number() OVER (PARTITION BY media_id ORDER BY k) AS r FROM m WHERE rms > 2 * m) SELECT media_id, min(k) AS k0, max(k) AS k1 FROM q GROUP BY media_id, r HAVING count(*) <= 2""")
def burst_runs(spark, d):
    return fr.bursts(frames(spark, d), M, 10, 2.0, 2).select("media_id", "k0", "k1")


@query("""WITH {S}, q AS (SELECT media_id, t0, t1, lag(t1) OVER (PARTITION BY media_id ORDER BY t0, t1) AS e FROM s WHERE speaker = 'click'), l AS (SELECT media_id, max(t1) + 3600 AS seconds FROM s GROUP BY media_id),
p AS (SELECT media_id, coalesce(e, 0) AS p0, t0 AS p1 FROM q UNION ALL SELECT l.media_id, coalesce(e.e, 0), seconds FROM l LEFT JOIN (SELECT media_id, arg_max(t1, struct_pack(a := t0, b := t1)) AS e FROM q GROUP BY media_id) e ON e.media_id = l.media_id)
SELECT media_id, CAST(round(p0 * 1000) AS BIGINT) AS p0_ms, CAST(round(p1 * 1000) AS BIGINT) AS p1_ms FROM p WHERE p1 - p0 >= 600""")
def silence_inversion(spark, d):
    lengths = spans(spark, d).groupBy(*M).agg((F.max("t1") + 3600).alias("seconds"))
    p = fr.inverted(_of(spark, d, "click"), lengths, M, 600.0)
    return p.select("media_id", *[F.round(F.col(c) * 1000).cast("long").alias(c + "_ms") for c in ("p0", "p1")])


def _cues(df):
    text = F.concat_ws(" ", "speaker", F.format_number("value", 1))
    return df.withColumn("text", text).withColumn("t1", F.greatest("t1", F.col("t0") + 1))


@query()
def dtw_alignment(spark, d):
    """Clicks against views by time warping; tests hold the kernel against small cases."""
    r = kn.align(_cues(_of(spark, d, "click")), _cues(_of(spark, d, "view")), M, 2 * HOUR)
    return r.select("media_id", F.array_join("left_ids", ",").alias("left_ids"), F.array_join("right_ids", ",").alias("right_ids"), "match_type", F.round("score", 6).alias("score"))


@query()
def greedy_matching(spark, d):
    """Clicks against views, each view used once."""
    return kn.greedy_match(_cues(_of(spark, d, "click")), _cues(_of(spark, d, "view")), M, 6 * HOUR).select("media_id", "id", "r_id", F.round("score", 6).alias("score"))


@query()
def event_matching(spark, d):
    """Cues of two sides by place where they are as many, else greedily; a test holds the operator against a loop."""
    return kn.match_events(_cues(_of(spark, d, "click")), _cues(_of(spark, d, "view")), M, 6 * HOUR).select("media_id", "id", "r_id", F.round("score", 6).alias("score"))


@query()
def overlap_dedup(spark, d):
    """Overlapping spans of one speaker reduced to one."""
    return kn.drop_overlapping(_cues(spans(spark, d)), M).select("id", "text")


@query()
def sequence_ratio_turns(spark, d):
    """Matching-block ratio of each turn's text and the next one's."""
    w = W.partitionBy("conv_id").orderBy("turn")
    ratio = F.pandas_udf(kn.sequence_ratio, "double")
    n = table(spark, d, "conversations").select("conv_id", "turn", "text", F.lead("text").over(w).alias("n")).where("n IS NOT NULL")
    return n.select("conv_id", "turn", F.round(ratio("text", "n"), 6).alias("ratio"))


def _blocks(spark, d, size):
    f = frames(spark, d).select("media_id", F.floor(F.col("k") / size).alias("block"), "k", (F.col("rms") / 100).alias("x"))
    return f.groupBy("media_id", "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda v: v["x"]).alias("samples"))


@query("WITH {S}, " + FRAMES + """, n AS (SELECT media_id, count(*) AS n, (count(*) - 32) // 8 * 8 AS last FROM f GROUP BY media_id)
SELECT f.media_id, k, round(CASE WHEN n < 32 OR (k >= 1 AND k <= last + 30) THEN rms / 100 ELSE 0 END, 6) AS sample FROM f JOIN n USING (media_id)""")
def spectral_roundtrip(spark, d):
    """Samples to spectra and back: what whole frames cover is the signal again."""
    b = _blocks(spark, d, 64)
    out = su.restored(su.spectra(b, M, 64, 32, 8), b, M, 64, 32, 8)
    return out.select("media_id", "block", F.posexplode("samples").alias("at", "x")).select("media_id", (F.col("block") * 64 + F.col("at")).alias("k"), F.round("x", 6).alias("sample"))


@query()
def spectral_gate(spark, d):
    """Noise of the first frames taken out of all; a test holds the operator against numpy over whole signals."""
    out = su.spectral_gate(_blocks(spark, d, 64), M, 64, -6.0, 4, 32, 8)
    return out.select("media_id", "block", F.posexplode("samples").alias("at", "x")).select("media_id", (F.col("block") * 64 + F.col("at")).alias("k"), F.round("x", 6).alias("sample"))
