"""Named queries over the driver's tables, each beside the SQL it is held against."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import text as tx
from ..functions import vector as vx
from ..operators import coalesce as co
from ..operators import intervals as iv
from ..operators import metrics as mx
from ..sources.tables import spans, table
from .registry import HOUR, MS, ORACLES, QUERIES, M, _ms, _of, query

__all__ = ["ORACLES", "QUERIES"]


@query(f"""WITH {{S}}, r AS (SELECT *, max(t1) OVER (PARTITION BY media_id ORDER BY t0, t1, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR t0 - reach > 3600 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY t0, t1, id ROWS UNBOUNDED PRECEDING) AS island FROM r),
g AS (SELECT media_id, min(t0) AS t0, max(t1) AS t1, count(*) AS members FROM i GROUP BY media_id, island)
SELECT media_id, members, {MS.format("t0")}, {MS.format("t1")} FROM g""")
def coalesce_running_max(spark, d):
    return co.coalesce_reach(spans(spark, d), M, HOUR).select("media_id", "members", *_ms("t0", "t1"))


@query(f"""WITH {{S}}, r AS (SELECT *, lag(t1) OVER (PARTITION BY media_id ORDER BY t0, t1, id) AS e FROM s),
i AS (SELECT *, sum(CASE WHEN e IS NULL OR t0 - e > 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY t0, t1, id ROWS UNBOUNDED PRECEDING) AS island FROM r),
g AS (SELECT media_id, min(t0) AS t0, max(t1) AS t1, count(*) AS members FROM i GROUP BY media_id, island)
SELECT media_id, members, {MS.format("t0")}, {MS.format("t1")} FROM g""")
def coalesce_predecessor(spark, d):
    return co.coalesce_previous(spans(spark, d), M, 2 * HOUR).select("media_id", "members", *_ms("t0", "t1"))


@query(f"""WITH {{S}}, r AS (SELECT *, lag(t1) OVER w AS e, lag(speaker) OVER w AS who FROM s WINDOW w AS (PARTITION BY media_id ORDER BY t0, t1, id)),
i AS (SELECT *, sum(CASE WHEN coalesce(speaker = who AND t0 - e >= 0 AND t0 - e <= 36000, false) THEN 0 ELSE 1 END) OVER (PARTITION BY media_id ORDER BY t0, t1, id ROWS UNBOUNDED PRECEDING) AS island FROM r),
g AS (SELECT media_id, max(speaker) AS speaker, min(t0) AS t0, max(t1) AS t1, count(*) AS members FROM i GROUP BY media_id, island)
SELECT media_id, speaker, members, {MS.format("t0")}, {MS.format("t1")} FROM g""")
def same_speaker_merge(spark, d):
    return co.same_speaker_runs(spans(spark, d), M, 10 * HOUR).select("media_id", "speaker", "members", *_ms("t0", "t1"))


@query(f"""WITH {{S}}, r AS (SELECT *, lead(t0) OVER w AS n, lead(speaker) OVER w AS who FROM s WINDOW w AS (PARTITION BY media_id ORDER BY t0, t1, id)),
g AS (SELECT id, t0, CASE WHEN n - t1 > 0 AND n - t1 <= 3600 AND coalesce(speaker = who, true) THEN n ELSE t1 END AS t1 FROM r)
SELECT id, {MS.format("t0")}, {MS.format("t1")} FROM g""")
def stitch_lead(spark, d):
    return co.stitch_next(spans(spark, d), M, HOUR).select("id", *_ms("t0", "t1"))


@query(f"""WITH {{S}}, f AS (SELECT id, media_id, t0, greatest(t1, t0 + 600) AS t1 FROM s),
r AS (SELECT *, lead(t0) OVER (PARTITION BY media_id ORDER BY t0, t1, id) AS n FROM f),
g AS (SELECT id, CASE WHEN n - t1 > 0 AND n - t1 < 1800 THEN n ELSE t1 END AS t1 FROM r)
SELECT id, {MS.format("t1")} FROM g""")
def end_time_checks(spark, d):
    return co.check_ends(spans(spark, d), M, 600.0, 1800.0).select("id", *_ms("t1"))


@query(f"""WITH {{S}}, n AS (SELECT id, media_id, CASE WHEN speaker = 'view' THEN NULL ELSE speaker END AS speaker, t0, t1 FROM s),
r AS (SELECT *, last_value(speaker IGNORE NULLS) OVER b AS a, first_value(speaker IGNORE NULLS) OVER f AS z,
  last_value(CASE WHEN speaker IS NOT NULL THEN t1 END IGNORE NULLS) OVER b AS ea, first_value(CASE WHEN speaker IS NOT NULL THEN t0 END IGNORE NULLS) OVER f AS sz,
  count(speaker) OVER (PARTITION BY media_id ORDER BY t0, t1, id ROWS UNBOUNDED PRECEDING) AS run FROM n
  WINDOW b AS (PARTITION BY media_id ORDER BY t0, t1, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         f AS (PARTITION BY media_id ORDER BY t0, t1, id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
q AS (SELECT *, min(t0) OVER (PARTITION BY media_id, run, speaker IS NULL) AS lo, max(t1) OVER (PARTITION BY media_id, run, speaker IS NULL) AS hi FROM r)
SELECT id, CASE WHEN speaker IS NULL AND a = z AND hi - lo <= 90000 AND lo - ea <= 90000 AND sz - hi <= 90000 THEN a ELSE speaker END AS speaker FROM q""")
def unknown_run_repair(spark, d):
    s = spans(spark, d).withColumn("speaker", F.when(F.col("speaker") == "view", None).otherwise(F.col("speaker")))
    return co.unknown_runs(s, M, 25 * HOUR, 25 * HOUR).select("id", "speaker")


@query(f"""WITH {{S}}, n AS (SELECT *, CAST(greatest(1, ceil((t1 - t0) / 900)) AS INTEGER) AS pieces FROM s),
p AS (SELECT id, pieces, CAST(unnest(range(pieces)) AS INTEGER) AS piece, t0, t1 FROM n),
g AS (SELECT id, piece, t0 + (t1 - t0) / pieces * piece AS p0, t0 + (t1 - t0) / pieces * (piece + 1) AS p1 FROM p)
SELECT id, piece, {MS.format("p0")}, {MS.format("p1")} FROM g""")
def split_long_spans(spark, d):
    return co.split_long(spans(spark, d), 900.0).select("id", "piece", *_ms("p0", "p1"))


@query("""WITH {S}, r AS (SELECT *, lag(t0) OVER (PARTITION BY media_id ORDER BY t0, t1, id) AS p FROM s)
SELECT id, media_id, speaker FROM r WHERE p IS NULL OR t0 - p > 7200""")
def start_proximity_dedup(spark, d):
    return co.start_dedup(spans(spark, d), M, 2 * HOUR).select("id", "media_id", "speaker")


@query("""WITH {S}, c AS (SELECT DISTINCT media_id, speaker, unnest(range(CAST(floor(t0 / 43200) AS BIGINT), CAST(greatest(ceil(t1 / 43200), floor(t0 / 43200) + 1) AS BIGINT))) AS cell FROM s),
v AS (SELECT media_id, cell, count(*) AS n FROM c GROUP BY ALL HAVING count(*) >= 2),
r AS (SELECT *, cell - row_number() OVER (PARTITION BY media_id ORDER BY cell) AS run FROM v)
SELECT media_id, min(cell) AS first_cell, max(cell) AS last_cell, max(n) AS most_votes FROM r GROUP BY media_id, run""")
def grid_consensus_vote(spark, d):
    return co.grid_vote(spans(spark, d), M, 12 * HOUR, 2)


@query("""WITH {S} SELECT a.id, count(*) AS overlaps, CAST(round(sum(least(a.t1, b.t1) - greatest(a.t0, b.t0)) * 1000) AS BIGINT) AS overlap_ms
FROM s a JOIN s b ON a.media_id = b.media_id AND a.id <> b.id AND a.t0 < b.t1 AND b.t0 < a.t1 GROUP BY a.id""")
def interval_overlap_agg(spark, d):
    s = spans(spark, d)
    pairs = iv.overlap_join(s, s, M, 2 * HOUR, extra=F.col("id") != F.col("r_id"))
    return pairs.groupBy("id").agg(F.count(F.lit(1)).alias("overlaps"), F.round(F.sum(iv.overlap_seconds()) * 1000).cast("long").alias("overlap_ms"))


@query("""WITH {S} SELECT id, media_id FROM s a WHERE speaker = 'click' AND NOT EXISTS
(SELECT 1 FROM s b WHERE b.media_id = a.media_id AND b.speaker <> 'click' AND a.t0 < b.t1 AND b.t0 < a.t1)""")
def uncovered_anti_range(spark, d):
    return iv.overlap_exists(_of(spark, d, "click"), _of(spark, d, "click", True), M, 2 * HOUR, anti=True).select("id", "media_id")


@query("""WITH {S} SELECT id, media_id FROM s a WHERE speaker = 'click' AND EXISTS
(SELECT 1 FROM s b WHERE b.media_id = a.media_id AND b.speaker <> 'click' AND a.t0 < b.t1 AND b.t0 < a.t1)""")
def covered_semi_range(spark, d):
    return iv.overlap_exists(_of(spark, d, "click"), _of(spark, d, "click", True), M, 2 * HOUR).select("id", "media_id")


@query("""WITH {S}, p AS (SELECT a.id, b.id AS best_id, least(a.t1, b.t1) - greatest(a.t0, b.t0) AS o, abs((a.t0 + a.t1) / 2 - (b.t0 + b.t1) / 2) AS away
FROM s a JOIN s b ON a.media_id = b.media_id AND a.id <> b.id AND a.t0 < b.t1 AND b.t0 < a.t1),
r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY o DESC, away, best_id DESC) AS k FROM p)
SELECT id, best_id, CAST(round(o * 1000) AS BIGINT) AS best_ms FROM r WHERE k = 1""")
def best_overlap_argmax(spark, d):
    s = spans(spark, d)
    best = iv.best_overlap(s, s, M, 2 * HOUR, extra=F.col("id") != F.col("r_id"))
    return best.select("id", "best_id", F.round(F.col("best_overlap") * 1000).cast("long").alias("best_ms"))


@query("""WITH {S}, p AS (SELECT id, media_id, (t0 + t1) / 2 AS t FROM s)
SELECT p.id, count(*) AS hits, CASE WHEN count(DISTINCT b.speaker) = 1 THEN max(b.speaker) END AS speaker
FROM p JOIN s b ON p.media_id = b.media_id AND b.t0 <= p.t AND p.t <= b.t1 GROUP BY p.id""")
def stab_join_midpoint(spark, d):
    s = spans(spark, d)
    hit = iv.stab_join(s.select("id", "media_id", ((F.col("t0") + F.col("t1")) / 2).alias("t")), s, M, 2 * HOUR)
    one = F.when(F.size(F.collect_set("r_speaker")) == 1, F.max("r_speaker"))
    return hit.groupBy("id").agg(F.count(F.lit(1)).alias("hits"), one.alias("speaker"))


@query("""WITH {S}, p AS (SELECT * FROM s WHERE speaker = 'click'), o AS (SELECT * FROM s WHERE speaker <> 'click')
SELECT p.id, CAST(round((SELECT max(t1) FROM o WHERE o.media_id = p.media_id AND o.t1 < p.t0) * 1000) AS BIGINT) AS prev_end_ms,
CAST(round((SELECT min(t0) FROM o WHERE o.media_id = p.media_id AND o.t0 > p.t0) * 1000) AS BIGINT) AS next_start_ms FROM p""")
def asof_directional(spark, d):
    points = _of(spark, d, "click").select("id", "media_id", F.col("t0").alias("t"))
    return iv.asof_neighbours(points, _of(spark, d, "click", True), M).select("id", *_ms("prev_end", "next_start"))


@query("""WITH {S}, r AS (SELECT *, max(t1) OVER (PARTITION BY media_id ORDER BY t0, t1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap0 FROM s)
SELECT media_id, CAST(round(gap0 * 1000) AS BIGINT) AS gap0_ms, CAST(round(t0 * 1000) AS BIGINT) AS gap1_ms FROM r WHERE gap0 < t0""")
def complement_gaps(spark, d):
    return iv.complement(spans(spark, d), M).select("media_id", *_ms("gap0", "gap1"))


@query("""WITH {S}, c AS (SELECT DISTINCT a.id, b.t0 AS t FROM s a JOIN s b ON a.media_id = b.media_id AND b.speaker = 'click' AND a.t0 < b.t0 AND b.t0 < a.t1
UNION SELECT id, t0 FROM s UNION SELECT id, t1 FROM s),
p AS (SELECT id, t AS t0, lead(t) OVER (PARTITION BY id ORDER BY t) AS t1, row_number() OVER (PARTITION BY id ORDER BY t) - 1 AS piece FROM c)
SELECT id, CAST(piece AS INTEGER) AS piece, CAST(round(t0 * 1000) AS BIGINT) AS t0_ms, CAST(round(t1 * 1000) AS BIGINT) AS t1_ms FROM p WHERE t1 IS NOT NULL""")
def cut_at_turns(spark, d):
    s = spans(spark, d).where("t1 > t0")
    return iv.cut_points(s, _of(spark, d, "click").select("media_id", F.col("t0").alias("t")), M, 2 * HOUR).select("id", "piece", *_ms("t0", "t1"))


@query("""WITH {S}, e AS (SELECT media_id, t0 AS t, 1 AS d FROM s UNION ALL SELECT media_id, t1, -1 FROM s),
r AS (SELECT media_id, sum(d) OVER (PARTITION BY media_id ORDER BY t, d ROWS UNBOUNDED PRECEDING) AS o FROM e)
SELECT media_id, CAST(max(o) AS BIGINT) AS most_open FROM r GROUP BY media_id""")
def concurrency_sweep(spark, d):
    return iv.concurrency(spans(spark, d), M)


@query("""WITH {S}, r AS (SELECT speaker, t0 - lag(t1) OVER (PARTITION BY media_id ORDER BY t0, t1, id) AS gap FROM s)
SELECT speaker, count(gap) AS n, round(quantile_cont(gap, 0.5), 3) AS median, round(quantile_cont(gap, 0.95), 3) AS p95, round(stddev_pop(gap), 2) AS sd FROM r GROUP BY speaker""")
def gap_quantiles(spark, d):
    gap = F.col("t0") - F.lag("t1").over(W.partitionBy("media_id").orderBy("t0", "t1", "id"))
    g = spans(spark, d).select("speaker", gap.alias("gap")).groupBy("speaker")
    return g.agg(F.count("gap").alias("n"), F.round(mx.percentile("gap", 0.5), 3).alias("median"), F.round(mx.percentile("gap", 0.95), 3).alias("p95"), F.round(F.stddev_pop("gap"), 2).alias("sd"))


@query("""WITH {S}, q AS (SELECT speaker, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM s GROUP BY speaker)
SELECT id, s.speaker FROM s JOIN q USING (speaker) WHERE value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)""")
def iqr_outliers(spark, d):
    return mx.iqr_outliers(spans(spark, d), ["speaker"], "value").select("id", "speaker")


@query("""WITH g AS (SELECT l_orderkey, l_linenumber, l_quantity AS gold FROM lineitem WHERE l_returnflag <> 'R'),
p AS (SELECT l_orderkey, l_linenumber, l_quantity * (1 - l_discount) AS got FROM lineitem WHERE l_linestatus = 'O'),
j AS (SELECT l_linenumber, gold, got, abs(got - gold) AS e FROM g FULL JOIN p USING (l_orderkey, l_linenumber))
SELECT l_linenumber, count(e) AS matched, count_if(got IS NULL) AS missing, count_if(gold IS NULL) AS extra, round(avg(e), 6) AS mae,
round(quantile_cont(e, 0.5), 6) AS median, round(quantile_cont(e, 0.95), 6) AS p95 FROM j GROUP BY l_linenumber""")
def boundary_error_report(spark, d):
    li, key = table(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"]
    gold = li.where("l_returnflag <> 'R'").select(*key, F.col("l_quantity").alias("gold"))
    got = li.where("l_linestatus = 'O'").select(*key, (F.col("l_quantity") * (1 - F.col("l_discount"))).alias("got"))
    r = mx.error_report(gold.join(got, key, "full"), ["l_linenumber"], "gold", "got")
    return r.select("l_linenumber", "matched", "missing", "extra", *[F.round(c, 6).alias(c) for c in ("mae", "median", "p95")])


@query("""WITH {S}, t AS (SELECT media_id, id, sign(value - lag(value) OVER (PARTITION BY media_id ORDER BY id)) AS g FROM s),
f AS (SELECT media_id, CASE WHEN g <> lag(g) OVER (PARTITION BY media_id ORDER BY id) THEN 1 ELSE 0 END AS f FROM t WHERE g <> 0)
SELECT media_id, CAST(sum(f) AS BIGINT) AS flips, count(*) AS steps FROM f GROUP BY media_id""")
def oscillation_flips(spark, d):
    return mx.direction_flips(spans(spark, d), M, "id", "value")


@query("""WITH {S}, l AS (SELECT media_id, max(t0) AS l FROM s GROUP BY media_id)
SELECT media_id, round(sum(pow(0.5, (l - t0) / 604800) * value) / sum(pow(0.5, (l - t0) / 604800)), 6) AS decayed, count(*) AS n FROM s JOIN l USING (media_id) GROUP BY media_id""")
def decay_weighted_mean(spark, d):
    return mx.decayed(spans(spark, d), M, "t0", "value", 604800.0).withColumn("decayed", F.round("decayed", 6))


@query("""WITH {S}, r AS (SELECT id, speaker, row_number() OVER (PARTITION BY speaker ORDER BY value DESC, id) AS rank FROM s) SELECT id, speaker, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""")
def top_spans_per_speaker(spark, d):
    return mx.top_per(spans(spark, d), ["speaker"], [F.desc("value"), F.col("id")], 10).select("id", "speaker", "rank")


@query("""WITH {S}, f AS (SELECT media_id, speaker, min(t0) AS t0 FROM s GROUP BY ALL)
SELECT media_id, speaker, CAST(dense_rank() OVER (PARTITION BY media_id ORDER BY t0, speaker) AS INTEGER) AS speaker_no FROM f""")
def speaker_dense_rank(spark, d):
    first = spans(spark, d).groupBy("media_id", "speaker").agg(F.min("t0").alias("t0"))
    return first.select("media_id", "speaker", F.dense_rank().over(W.partitionBy("media_id").orderBy("t0", "speaker")).alias("speaker_no"))


@query("""WITH {S}, c AS (SELECT media_id, speaker, count(*) AS n FROM s GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY n DESC, speaker) AS k FROM c)
SELECT media_id, speaker, n FROM r WHERE k = 1""")
def majority_speaker(spark, d):
    c = spans(spark, d).groupBy("media_id", "speaker").agg(F.count(F.lit(1)).alias("n"))
    return mx.top_per(c, M, [F.desc("n"), F.col("speaker")], 1, "k").drop("k")


@query("""WITH {S} SELECT id, CAST(sum(CAST(round(value * 1000) AS BIGINT)) OVER (PARTITION BY media_id ORDER BY t0, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS offset_ms FROM s""")
def running_offset(spark, d):
    w = W.partitionBy("media_id").orderBy("t0", "id").rowsBetween(W.unboundedPreceding, -1)
    return spans(spark, d).select("id", F.sum(F.round(F.col("value") * 1000).cast("long")).over(w).alias("offset_ms"))


@query("""WITH {S}, n AS (SELECT *, lead(t0) OVER (PARTITION BY media_id ORDER BY t0, t1, id) AS nx FROM s)
SELECT media_id, count_if(t1 <= t0) AS empty_spans, count_if(nx < t1) AS overlaps, count_if(speaker IS NULL) AS unknown, count(*) AS n FROM n GROUP BY media_id""")
def integrity_violations(spark, d):
    nx = F.lead("t0").over(W.partitionBy("media_id").orderBy("t0", "t1", "id"))
    s = spans(spark, d).withColumn("nx", nx)
    c = lambda cond, name: F.count_if(cond).alias(name)
    return s.groupBy("media_id").agg(c(F.col("t1") <= F.col("t0"), "empty_spans"), c(F.col("nx") < F.col("t1"), "overlaps"), c(F.col("speaker").isNull(), "unknown"), F.count(F.lit(1)).alias("n"))


@query("""SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders WHERE o_orderstatus = 'F') WHERE k = 1""")
def history_latest_completed(spark, d):
    done = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return mx.top_per(done, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")], 1, "k").select("o_custkey", "o_orderkey", "o_totalprice")


@query("""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
n AS (SELECT *, lead(v) OVER (PARTITION BY label ORDER BY vec_id) AS n, lead(vec_id) OVER (PARTITION BY label ORDER BY vec_id) AS next_id FROM v)
SELECT vec_id, next_id, round(list_cosine_similarity(v, n), 6) AS cosine FROM n WHERE next_id IS NOT NULL""")
def vector_cosine(spark, d):
    w = W.partitionBy("label").orderBy("vec_id")
    v = table(spark, d, "embeddings").select("vec_id", "label", vx.doubles(F.col("embedding")).alias("v"))
    n = v.withColumn("n", F.lead("v").over(w)).withColumn("next_id", F.lead("vec_id").over(w)).where("next_id IS NOT NULL")
    return n.select("vec_id", "next_id", F.round(vx.cosine(F.col("v"), F.col("n")), 6).alias("cosine"))


@query("""WITH e AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM e GROUP BY ALL)
SELECT label, CAST(i AS INTEGER) AS i, round(x, 6) AS x FROM c""")
def centroids(spark, d):
    e = table(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("p", "x"))
    return e.groupBy("label", (F.col("p") + 1).alias("i")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))


@query(r"""SELECT doc_id, trim(regexp_replace(lower(text), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS norm, text SIMILAR TO '(.|\n)*[.!?。！？…][ \t\n\x0B\f\r]*' AS ends FROM documents""")
def normalise_text(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", tx.squeeze(t).alias("norm"), tx.ends_sentence(t).alias("ends"))


@query(r"""WITH w AS (SELECT lang, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS word FROM documents), c AS (SELECT lang, word, count(*) AS n FROM w GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY n DESC, word) AS rank FROM c) SELECT lang, word, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20""")
def keyword_topk(spark, d):
    w = table(spark, d, "documents").select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0))).alias("word"))
    return mx.top_per(w.groupBy("lang", "word").agg(F.count(F.lit(1)).alias("n")), ["lang"], [F.desc("n"), F.col("word")], 20)


@query(r"""WITH t AS (SELECT conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM conversations),
p AS (SELECT a.conv_id, a.turn, len(list_intersect(a.w, b.w)) AS i, len(a.w) + len(b.w) AS s FROM t a JOIN t b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
SELECT conv_id, turn, round(CASE WHEN s = 0 THEN 0 ELSE i / CAST(s - i AS DOUBLE) END, 6) AS jaccard FROM p""")
def jaccard_turns(spark, d):
    t = table(spark, d, "conversations").select("conv_id", "turn", tx.words(F.col("text")).alias("w"))
    n = t.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("w").alias("n"))
    return t.join(n, ["conv_id", "turn"]).select("conv_id", "turn", F.round(tx.jaccard(F.col("w"), F.col("n")), 6).alias("jaccard"))


@query("""WITH n AS (SELECT p_partkey AS a_key, p_name, lead(p_partkey) OVER w AS b_key, lead(p_name) OVER w AS n FROM part WINDOW w AS (PARTITION BY p_brand ORDER BY p_partkey))
SELECT a_key, b_key, levenshtein(p_name, n) AS distance FROM n WHERE b_key IS NOT NULL""")
def levenshtein_pairs(spark, d):
    w = W.partitionBy("p_brand").orderBy("p_partkey")
    n = table(spark, d, "part").select(F.col("p_partkey").alias("a_key"), "p_name", F.lead("p_partkey").over(w).alias("b_key"), F.lead("p_name").over(w).alias("n"))
    return n.where("b_key IS NOT NULL").select("a_key", "b_key", F.levenshtein("p_name", "n").cast("long").alias("distance"))


@query("""WITH u AS (SELECT l_suppkey AS k, 'line' AS src, 2 AS pri, CAST(l_quantity AS DOUBLE) AS v FROM lineitem UNION ALL SELECT s_suppkey, 'supplier', 1, s_acctbal FROM supplier),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY pri, v DESC) AS n FROM u) SELECT k, src, v FROM r WHERE n = 1""")
def multi_source_priority(spark, d):
    a = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), F.lit("line").alias("src"), F.lit(2).alias("pri"), F.col("l_quantity").cast("double").alias("v"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.lit("supplier").alias("src"), F.lit(1).alias("pri"), F.col("s_acctbal").alias("v"))
    return mx.top_per(a.unionByName(b), ["k"], [F.col("pri"), F.desc("v")], 1, "n").select("k", "src", "v")


@query("""WITH {S}, n AS (SELECT *, lead(t0) OVER (PARTITION BY media_id ORDER BY t0, t1, id) - t1 AS gap, lead(speaker) OVER (PARTITION BY media_id ORDER BY t0, t1, id) AS nx FROM s)
SELECT id, CASE WHEN gap IS NULL THEN 'last' WHEN gap > 86400 THEN 'keep' WHEN speaker <> nx THEN 'keep' WHEN gap < 3600 THEN 'fast' WHEN gap < 14400 THEN 'merge' ELSE 'unresolved' END AS decision FROM n""")
def tiered_merge_decision(spark, d):
    w = W.partitionBy("media_id").orderBy("t0", "t1", "id")
    n = spans(spark, d).withColumn("gap", F.lead("t0").over(w) - F.col("t1")).withColumn("nx", F.lead("speaker").over(w))
    g = F.col("gap")
    said = F.when(g.isNull(), "last").when(g > 86400, "keep").when(F.col("speaker") != F.col("nx"), "keep").when(g < 3600, "fast").when(g < 14400, "merge").otherwise("unresolved")
    return n.select("id", said.alias("decision"))


@query("""SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k, count(*) AS n, sha256(event_type) AS key_hash FROM events GROUP BY ALL""")
def json_props_rollup(spark, d):
    e = table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("k"))
    return e.groupBy("event_type", "k").agg(F.count(F.lit(1)).alias("n")).withColumn("key_hash", F.sha2("event_type", 256))


from . import assembly, attribution, dialogue, energy, events, feedback, keys, textual, timeline, unions, voices  # noqa: E402, F401  registers their queries
