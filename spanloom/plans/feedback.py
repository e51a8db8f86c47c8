"""Queries for scores, gates and learning rules; the TPC-like tables stand in for run histories."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import vector as vx
from ..operators import feedback as fb
from ..operators import intervals as iv
from ..operators import metrics as mx
from ..sources.tables import spans, table
from .registry import HOUR, M, _of, query

LINKS = """a AS (SELECT * FROM s WHERE speaker = 'click'), b AS (SELECT * FROM s WHERE speaker = 'view'),
l AS (SELECT a.media_id, a.id, b.id AS r_id, (least(a.t1, b.t1) - greatest(a.t0, b.t0)) / (greatest(a.t1, b.t1) - least(a.t0, b.t0)) AS iou, 1 - abs(a.value - b.value) / greatest(a.value, b.value) AS sim
FROM a JOIN b ON a.media_id = b.media_id AND a.t0 < b.t1 AND b.t0 < a.t1), d AS (SELECT *, count(*) OVER (PARTITION BY id) AS x, count(*) OVER (PARTITION BY r_id) AS y FROM l),
p AS (SELECT media_id, id, r_id, iou, sim, CASE WHEN x = 1 AND y = 1 THEN '1:1' WHEN x = 1 THEN 'N:1' WHEN y = 1 THEN '1:N' ELSE 'N:M' END AS match_type FROM d
UNION ALL SELECT media_id, id, NULL, NULL, NULL, 'INSERT' FROM a WHERE id NOT IN (SELECT id FROM l) UNION ALL SELECT media_id, NULL, id, NULL, NULL, 'DELETE' FROM b WHERE id NOT IN (SELECT r_id FROM l))"""


def _pairs(spark, d):
    a, b = _of(spark, d, "click"), _of(spark, d, "view")
    met = iv.overlap_join(a, b, M, 2 * HOUR)
    iou = iv.overlap_seconds() / (F.greatest("t1", "r_t1") - F.least("t0", "r_t0"))
    sim = 1 - F.abs(F.col("value") - F.col("r_value")) / F.greatest("value", "r_value")
    return a, b, fb.pair_sides(a, b, met.select(*M, "id", "r_id", iou.alias("iou"), sim.alias("sim")), M)


@query("WITH {S}, " + LINKS + " SELECT id, r_id, match_type, round(iou, 6) AS iou FROM p")
def residual_pairs(spark, d):
    return _pairs(spark, d)[2].select("id", "r_id", "match_type", F.round("iou", 6).alias("iou"))


@query("WITH {S}, " + LINKS + """, n AS (SELECT media_id, count_if(speaker = 'click') AS na, count_if(speaker = 'view') AS nb FROM s GROUP BY media_id),
g AS (SELECT media_id, count(*) AS c, coalesce(avg(CASE WHEN match_type NOT IN ('INSERT', 'DELETE') AND sim > 0 THEN sim END), 0) * 100 AS x, coalesce(avg(CASE WHEN match_type NOT IN ('INSERT', 'DELETE') AND iou > 0 THEN iou END), 0) * 100 AS y,
avg(CASE WHEN match_type = '1:1' THEN 1 ELSE 0 END) * 100 AS z FROM p GROUP BY media_id),
h AS (SELECT media_id, CAST(coalesce(c, 0) * 100 AS DOUBLE) / greatest(na, nb, 1) * CAST(0.35 AS DOUBLE) + coalesce(x, 0) * 0.35 + coalesce(y, 0) * 0.2 + coalesce(z, 0) * 0.1 AS health FROM n LEFT JOIN g USING (media_id))
SELECT media_id, round(health, 4) AS health, CASE WHEN health >= 85 THEN 'excellent' WHEN health >= 70 THEN 'good' WHEN health >= 50 THEN 'fair' ELSE 'poor' END AS grade FROM h""")
def health_score(spark, d):
    a, b, pairs = _pairs(spark, d)
    who = F.col("speaker")
    sizes = spans(spark, d).groupBy(*M).agg(F.count_if(who == "click").alias("n_auto"), F.count_if(who == "view").alias("n_manual"))
    return fb.health(pairs, sizes, M).select("media_id", F.round("health", 4).alias("health"), fb.grade(F.col("health")).alias("grade"))


@query("""WITH {S}, m AS (SELECT media_id, count(*) AS n, avg(value) AS mean, stddev_pop(value) AS sd FROM s GROUP BY media_id)
SELECT media_id, concat_ws(',', CASE WHEN n < 60 THEN 'few' END, CASE WHEN mean > 10 THEN 'mean' END, CASE WHEN sd > 12 THEN 'spread' END) AS reasons, NOT (n < 60 OR mean > 10 OR sd > 12) AS eligible FROM m""")
def rollout_gate(spark, d):
    m = spans(spark, d).groupBy(*M).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("sd"))
    g = fb.gate(m, {"few": ("n", "min", 60), "mean": ("mean", "max", 10), "spread": ("sd", "max", 12)})
    return g.select("media_id", F.array_join("reasons", ",").alias("reasons"), "eligible")


@query("""WITH RECURSIVE o AS (SELECT o_custkey, CAST(o_totalprice AS DOUBLE) AS v, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS k FROM orders),
f AS (SELECT o_custkey, k, greatest(CAST(50000 AS DOUBLE), least(CAST(200000 AS DOUBLE), v)) AS e FROM o WHERE k = 1 UNION ALL
SELECT o.o_custkey, o.k, greatest(CAST(50000 AS DOUBLE), least(CAST(200000 AS DOUBLE), e + (v - e) * CAST(0.25 AS DOUBLE))) FROM f JOIN o ON o.o_custkey = f.o_custkey AND o.k = f.k + 1)
SELECT o_custkey, arg_max(e, k) AS ema, CAST(max(k) AS INTEGER) AS steps FROM f GROUP BY o_custkey""")
def ema_bounded(spark, d):
    e = fb.ema(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", 0.25, 50000.0, 200000.0)
    return e.select("o_custkey", "ema", "steps")


@query("""WITH c AS (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL) SELECT o_custkey, n, CAST(CASE WHEN n <= 2 THEN 0 WHEN n <= 5 THEN 0.15 WHEN n <= 15 THEN 0.25 ELSE 0.35 END AS DOUBLE) AS rate FROM c""")
def learn_rates(spark, d):
    c = table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return c.select("o_custkey", "n", fb.learn_rate(F.col("n")).alias("rate"))


@query("""WITH m AS (SELECT max(CAST(o_orderdate AS DATE)) AS last FROM orders), w AS (SELECT o_custkey, o_orderkey, exp(-datediff('day', CAST(o_orderdate AS DATE), last) / CAST(180 AS DOUBLE)) AS w FROM orders, m),
r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY w DESC, o_orderkey) AS rank FROM w WHERE w >= 0.3) SELECT o_custkey, o_orderkey, round(w, 6) AS weight, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def efold_topk(spark, d):
    o = table(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    last = o.agg(F.max("day")).first()[0]
    w = o.withColumn("w", fb.efold(F.datediff(F.lit(last), "day"), 180.0)).where("w >= 0.3")
    return mx.top_per(w, ["o_custkey"], [F.desc("w"), F.col("o_orderkey")], 3).select("o_custkey", "o_orderkey", F.round("w", 6).alias("weight"), "rank")


@query("""WITH {S}, m AS (SELECT speaker, quantile_cont(value, 0.5) AS m FROM s GROUP BY speaker) SELECT speaker, round(any_value(m), 6) AS median, round(quantile_cont(abs(value - m), 0.5) * CAST(1.4826 AS DOUBLE), 6) AS mad FROM s JOIN m USING (speaker) GROUP BY speaker""")
def median_deviation(spark, d):
    return fb.mad(spans(spark, d), ["speaker"], "value").select("speaker", F.round("median", 6).alias("median"), F.round("mad", 6).alias("mad"))


@query("""WITH {S}, g AS (SELECT media_id, t0 - lag(t1) OVER (PARTITION BY media_id ORDER BY t0, t1, id) AS gap FROM s), t AS (SELECT media_id, quantile_cont(gap, 0.95) AS top FROM g WHERE gap > 0 GROUP BY media_id)
SELECT g.media_id, count(*) AS n, round(quantile_cont(gap, 0.25), 3) AS short, round(quantile_cont(gap, 0.6), 3) AS medium, round(quantile_cont(gap, 0.85), 3) AS long FROM g JOIN t ON g.media_id = t.media_id AND gap > 0 AND gap <= top GROUP BY g.media_id HAVING count(*) >= 3""")
def pause_thresholds(spark, d):
    gap = F.col("t0") - F.lag("t1").over(W.partitionBy(*M).orderBy("t0", "t1", "id"))
    return fb.pause_thresholds(spans(spark, d).select(*M, gap.alias("gap")), M, "gap", 3).select("media_id", "n", *[F.round(c, 3).alias(c) for c in ("short", "medium", "long")])


@query("""WITH {S}, x AS (SELECT media_id, id, value - lag(value) OVER (PARTITION BY media_id ORDER BY id) AS d FROM s), k AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY id DESC) AS k FROM x WHERE d IS NOT NULL),
g AS (SELECT media_id, k, sign(d) AS g FROM k WHERE k <= 5 AND d <> 0), f AS (SELECT media_id, CASE WHEN g <> lag(g) OVER (PARTITION BY media_id ORDER BY k DESC) THEN 1 ELSE 0 END AS f FROM g),
n AS (SELECT media_id, CAST(sum(f) AS BIGINT) AS flips FROM f GROUP BY media_id) SELECT media_id, flips, CASE WHEN flips >= 3 THEN 'lock' WHEN flips >= 2 THEN 'oscillating' ELSE 'stable' END AS state FROM n""")
def recent_oscillation(spark, d):
    delta = F.col("value") - F.lag("value").over(W.partitionBy(*M).orderBy("id"))
    return fb.recent_flips(spans(spark, d).withColumn("d", delta).where("d IS NOT NULL"), M, [F.col("id")], "d")


@query("""WITH r AS (SELECT l_suppkey, avg(CAST(l_quantity AS DOUBLE)) AS b, avg(CAST(l_quantity AS DOUBLE) * (1 + l_tax)) AS t, count(*) AS runs FROM lineitem GROUP BY l_suppkey)
SELECT l_suppkey, runs, round((t - b) / b, 6) AS gain, CASE WHEN runs < 30 THEN 'wait' WHEN (t - b) / b >= 0.04 THEN 'upgrade' ELSE 'keep' END AS verdict FROM r""")
def shadow_verdict(spark, d):
    q = F.col("l_quantity").cast("double")
    r = table(spark, d, "lineitem").select("l_suppkey", q.alias("base"), (q * (1 + F.col("l_tax"))).alias("trial"))
    return fb.shadow_verdict(r, ["l_suppkey"], "base", "trial", 30, 0.04).select("l_suppkey", "runs", F.round("gain", 6).alias("gain"), "verdict")


@query("""WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), m AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM e GROUP BY ALL), c AS (SELECT label, list(x ORDER BY i) AS c FROM m GROUP BY label),
j AS (SELECT vec_id, c.label, list_cosine_similarity(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), c) AS s FROM embeddings, c), r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS k FROM j),
g AS (SELECT vec_id, max(CASE WHEN k = 1 THEN label END) AS nearest, max(CASE WHEN k = 1 THEN s END) AS a, max(CASE WHEN k = 2 THEN s END) AS b, avg(s) AS m FROM r WHERE k <= 3 GROUP BY vec_id)
SELECT vec_id, nearest, round(a, 5) AS top1, a >= 0.3 AND a >= m + 0.08 AND coalesce(a - b >= 0.05, true) AS accepted FROM g""")
def centroid_margin(spark, d):
    v = table(spark, d, "embeddings").select("vec_id", "label", vx.doubles(F.col("embedding")).alias("v"))
    mean = v.select("label", F.posexplode("v").alias("i", "x")).groupBy("label", "i").agg(F.avg("x").alias("x"))
    c = mean.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("c"))
    hits = fb.nearest_centroids(v.select("vec_id", "v"), c, 3)
    m = fb.margin_accept(hits, "vec_id", "cosine", best=0.3, label="label")
    return m.select("vec_id", "nearest", F.round("top1", 5).alias("top1"), "accepted")
