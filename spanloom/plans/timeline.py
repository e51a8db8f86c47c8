"""Queries over spans: reconciling, nearest edges, clips, folds and windows on the timeline."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import coalesce as co
from ..operators import folds as fo
from ..operators import intervals as iv
from ..sources.tables import spans, table
from .registry import HOUR, MS, M, _ms, _of, query

SNAP = "CASE WHEN abs({0} - r0) <= 60 THEN r0 WHEN abs({0} - r1) <= 60 THEN r1 ELSE {0} END"
ORD = "PARTITION BY media_id ORDER BY t0, t1, id"


@query(f"""WITH {{S}}, r AS (SELECT id, media_id, t0 AS r0, t1 AS r1 FROM s WHERE speaker = 'click' AND t1 > t0),
p AS (SELECT r.*, b.speaker, b.id AS bid, b.t0 AS b0, b.t1 AS b1, greatest(r0, b.t0) AS x, least(r1, b.t1) AS y FROM r JOIN s b ON r.media_id = b.media_id AND b.speaker <> 'click' AND b.t1 > b.t0 AND b.t0 < r1 AND b.t1 > r0),
q AS (SELECT *, {SNAP.format("x")} AS ps, {SNAP.format("y")} AS pe FROM p),
c AS (SELECT *, coalesce(max(CASE WHEN pe > ps THEN pe END) OVER (PARTITION BY id ORDER BY b0, b1, bid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), r0) AS cov FROM q),
z AS (SELECT id, max(CASE WHEN pe > ps THEN pe END) AS cov FROM q GROUP BY id),
a AS (SELECT id, speaker, ps AS p0, pe AS p1 FROM c WHERE pe > ps UNION ALL SELECT id, NULL, cov, ps FROM c WHERE ps > cov + 1e-6
UNION ALL SELECT r.id, NULL, coalesce(cov, r0), r1 FROM r LEFT JOIN z USING (id) WHERE coalesce(cov, r0) < r1 - 1e-6)
SELECT id, speaker, {MS.format("p0")}, {MS.format("p1")} FROM a""")
def turn_reconcile(spark, d):
    return iv.reconcile(_of(spark, d, "click"), _of(spark, d, "click", True), M, 2 * HOUR, 60.0).select("id", "speaker", *_ms("p0", "p1"))


@query("""WITH {S}, p AS (SELECT id, media_id, t0 AS t FROM s WHERE speaker = 'click'),
j AS (SELECT p.id, bool_or(b.t0 <= t AND t <= b.t1) AS inside, min(CASE WHEN b.t0 > t THEN b.t0 - t WHEN b.t1 < t THEN t - b.t1 ELSE 0 END) AS away
FROM p LEFT JOIN s b ON p.media_id = b.media_id AND b.speaker <> 'click' AND b.t1 >= b.t0 GROUP BY p.id)
SELECT id, coalesce(inside, false) AS inside, CAST(round(away * 1000) AS BIGINT) AS distance_ms FROM j""")
def asof_nearest_edge(spark, d):
    points = _of(spark, d, "click").select("id", "media_id", F.col("t0").alias("t"))
    return iv.nearest_edge(points, _of(spark, d, "click", True), M).select("id", "inside", *_ms("distance"))


@query(f"""WITH {{S}}, r AS (SELECT id, t1, greatest(t0, max(t1) OVER ({ORD} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS c0 FROM s)
SELECT id, {MS.format("c0")}, {MS.format("t1")} FROM r WHERE c0 < t1""")
def ownership_clips(spark, d):
    return iv.ownership(spans(spark, d), M).select("id", *_ms("c0", "t1"))


@query("""WITH {S}, a AS (SELECT * FROM s WHERE speaker = 'click'),
o AS (SELECT a.id, sum(least(a.t1, b.t1) - greatest(a.t0, b.t0)) AS o FROM a JOIN s b ON a.media_id = b.media_id AND b.speaker <> 'click' AND a.t0 < b.t1 AND b.t0 < a.t1 GROUP BY a.id),
h AS (SELECT a.id, CASE WHEN t1 <= t0 THEN 0 ELSE least(1, coalesce(o, 0) / (t1 - t0)) END AS share FROM a LEFT JOIN o USING (id))
SELECT id, round(share, 6) AS share, CASE WHEN share > 0.5 THEN 'high' WHEN share > 0.1 THEN 'low' ELSE 'none' END AS class FROM h""")
def overlap_share_class(spark, d):
    h = iv.overlap_share(_of(spark, d, "click"), _of(spark, d, "click", True), M, 2 * HOUR)
    return h.select("id", F.round("share", 6).alias("share"), F.when(F.col("share") > 0.5, "high").when(F.col("share") > 0.1, "low").otherwise("none").alias("class"))


@query("""WITH {S}, n AS (SELECT *, t1 - t0 AS d, CAST(greatest(floor((t1 - t0 - 900) / 300) + 1, 0) AS INTEGER) AS n FROM s),
w AS (SELECT id, CAST(unnest(range(n)) AS INTEGER) AS k, t0, t1, n FROM n), a AS (SELECT id, k AS "window", t0 + k * 300 AS w0, t1 FROM w
UNION ALL SELECT id, n, greatest(t0, t1 - 900), t1 FROM n WHERE n = 0 OR t0 + (n - 1) * 300 + 900 < t1 - 1e-9)
SELECT id, "window", CAST(round(w0 * 1000) AS BIGINT) AS w0_ms, CAST(round(least(w0 + 900, t1) * 1000) AS BIGINT) AS w1_ms FROM a""")
def sliding_windows(spark, d):
    return iv.sliding(spans(spark, d), 900.0, 300.0).select("id", "window", *_ms("w0", "w1"))


@query("""WITH {S}, c AS (SELECT * FROM s WHERE speaker <> 'click'), e AS (SELECT id, id - 1 AS clip_id, media_id, t0, t1 FROM s WHERE speaker = 'click'),
r AS (SELECT id, t0, max(t1) OVER (PARTITION BY media_id ORDER BY t0, t1, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM c),
o AS (SELECT e.*, c.t0 AS c0, c.t1 AS c1 FROM e LEFT JOIN c ON e.clip_id = c.id)
SELECT 'empty range' AS rule, id FROM c WHERE t1 <= t0 UNION ALL SELECT 'overlap', id FROM r WHERE t0 < r UNION ALL
SELECT CASE WHEN c0 IS NULL THEN 'no clip' ELSE 'outside its clip' END, id FROM o WHERE c0 IS NULL OR t0 < c0 OR t1 > c1""")
def timeline_integrity(spark, d):
    evidence = _of(spark, d, "click").withColumn("clip_id", F.col("id") - 1)
    return iv.timeline_errors(_of(spark, d, "click", True), evidence, M)


@query("""WITH {S}, b AS (SELECT * FROM s WHERE speaker = 'click'), c AS (SELECT *, NOT EXISTS (SELECT 1 FROM s w WHERE w.media_id = b.media_id AND w.speaker <> 'click' AND b.t0 < w.t1 AND w.t0 < b.t1) AS bare FROM b)
SELECT media_id, count(*) AS bins, count_if(bare) AS uncovered, CAST(round(coalesce(sum(CASE WHEN bare THEN t1 - t0 END), 0) * 1000) AS BIGINT) AS uncovered_ms, CAST(round(max(CASE WHEN NOT bare THEN t1 END) * 1000) AS BIGINT) AS last_covered_ms FROM c GROUP BY media_id""")
def coverage_audit(spark, d):
    b = _of(spark, d, "click")
    hit = iv.overlap_exists(b, _of(spark, d, "click", True), M, 2 * HOUR).select("id", F.lit(True).alias("hit"))
    c = b.join(hit, "id", "left").withColumn("bare", F.col("hit").isNull())
    lost = F.coalesce(F.sum(F.when(F.col("bare"), F.col("t1") - F.col("t0"))), F.lit(0.0))
    ms = lambda x: F.round(x * 1000).cast("long")
    return c.groupBy("media_id").agg(F.count(F.lit(1)).alias("bins"), F.count_if("bare").alias("uncovered"), ms(lost).alias("uncovered_ms"), ms(F.max(F.when(~F.col("bare"), F.col("t1")))).alias("last_covered_ms"))


@query(f"""WITH RECURSIVE {{S}}, o AS (SELECT *, row_number() OVER ({ORD}) AS k FROM s),
f AS (SELECT media_id, k, CAST(1 AS BIGINT) AS g, t0, t1, speaker FROM o WHERE k = 1 UNION ALL
SELECT o.media_id, o.k, CASE WHEN j THEN g ELSE g + 1 END, CASE WHEN j THEN p0 ELSE t0 END, t1, CASE WHEN j THEN who ELSE speaker END
FROM (SELECT o.*, f.g, f.t0 AS p0, f.speaker AS who, (f.t1 - f.t0 < 600 OR o.t1 - o.t0 < 600) AND o.t0 - f.t1 < 43200 AND o.speaker = f.speaker AS j FROM f JOIN o ON o.media_id = f.media_id AND o.k = f.k + 1) o),
z AS (SELECT media_id, g, any_value(speaker) AS speaker, min(t0) AS t0, arg_max(t1, k) AS t1, count(*) AS members FROM f GROUP BY media_id, g)
SELECT media_id, speaker, CAST(members AS INTEGER) AS members, {MS.format("t0")}, {MS.format("t1")} FROM z""")
def short_cue_merge(spark, d):
    return fo.merge_short(spans(spark, d), M, 600.0, 12 * HOUR).select("media_id", "speaker", "members", *_ms("t0", "t1"))


@query(f"""WITH RECURSIVE {{S}}, o AS (SELECT media_id, t0, t1, row_number() OVER ({ORD}) AS k, lead(t0) OVER ({ORD}) AS n0, lead(t1) OVER ({ORD}) AS n1 FROM s),
f AS (SELECT media_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS g, CAST(NULL AS DOUBLE) AS g0, CAST(NULL AS DOUBLE) AS g1, 'out' AS act FROM (SELECT DISTINCT media_id FROM o) UNION ALL
SELECT media_id, k, CASE WHEN act IN ('skip', 'back') THEN g ELSE g + 1 END, CASE WHEN act IN ('skip', 'back') THEN g0 ELSE t0 END, CASE act WHEN 'skip' THEN g1 WHEN 'back' THEN greatest(g1, t1) WHEN 'forward' THEN n1 ELSE t1 END, act
FROM (SELECT o.*, f.g, f.g0, f.g1, CASE WHEN f.act = 'forward' THEN 'skip' WHEN o.t1 - o.t0 >= 300 THEN 'out' WHEN coalesce(n0 - o.t1 < 7200 AND (g1 IS NULL OR n0 - o.t1 <= o.t0 - g1), false) THEN 'forward'
WHEN coalesce(o.t0 - g1 < 7200, false) THEN 'back' ELSE 'out' END AS act FROM f JOIN o ON o.media_id = f.media_id AND o.k = f.k + 1) x),
z AS (SELECT media_id, g, min(g0) AS t0, arg_max(g1, k) AS t1 FROM f WHERE k > 0 GROUP BY media_id, g)
SELECT media_id, {MS.format("t0")}, {MS.format("t1")} FROM z""")
def fragment_protection(spark, d):
    return fo.protect_fragments(spans(spark, d), M, 300.0, 2 * HOUR).select("media_id", *_ms("t0", "t1"))


@query(f"""WITH {{S}}, l AS (SELECT *, row_number() OVER (PARTITION BY media_id, t0 ORDER BY t1 DESC, id DESC) AS k FROM s WHERE t1 > t0),
n AS (SELECT id, t0, least(t1, lead(t0) OVER (PARTITION BY media_id ORDER BY t0)) AS t1 FROM l WHERE k = 1)
SELECT id, {MS.format("t0")}, {MS.format("t1")} FROM n""")
def validate_trim(spark, d):
    return fo.trim_overlaps(spans(spark, d), M).select("id", *_ms("t0", "t1"))


@query(f"""WITH RECURSIVE {{S}}, w AS (SELECT id, media_id, t0, t1 FROM s WHERE speaker = 'click'), b AS (SELECT media_id, t0 AS b0, t1 AS b1 FROM s WHERE speaker <> 'click'),
n AS (SELECT w.id, arg_min(b1, struct_pack(a := b0, b := b1)) AS b1, min(b0) AS b0 FROM w JOIN b ON w.media_id = b.media_id AND w.t0 >= b1 AND w.t0 - b1 <= 3600 GROUP BY w.id),
o AS (SELECT w.*, n.b0, n.b1, row_number() OVER (PARTITION BY media_id ORDER BY t0, t1, w.id) AS k FROM w LEFT JOIN n ON n.id = w.id),
f AS (SELECT media_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS id, CAST(NULL AS DOUBLE) AS t0, CAST(NULL AS DOUBLE) AS t1, false AS repaired FROM (SELECT DISTINCT media_id FROM o) UNION ALL
SELECT media_id, k, id, CASE WHEN fits THEN st ELSE t0 END, CASE WHEN fits THEN b1 ELSE t1 END, fits FROM (SELECT *, b1 IS NOT NULL AND coalesce(st < b1, false) AS fits FROM
(SELECT o.*, greatest(o.b0, CASE WHEN o.t0 - f.t1 <= 86400 THEN f.t1 END) AS st FROM f JOIN o ON o.media_id = f.media_id AND o.k = f.k + 1) x) y)
SELECT id, repaired, {MS.format("t0")}, {MS.format("t1")} FROM f WHERE k > 0""")
def late_word_repair(spark, d):
    return fo.repair_late(_of(spark, d, "click"), _of(spark, d, "click", True), M, HOUR, HOUR, 24 * HOUR).select("id", "repaired", *_ms("t0", "t1"))


@query(f"""WITH RECURSIVE c AS (SELECT conv_id, turn, coalesce(text, '') AS text FROM conversations),
f AS (SELECT conv_id, turn, turn AS kept, text FROM c WHERE turn = 0 UNION ALL SELECT c.conv_id, c.turn, CASE WHEN (contains(f.text, c.text) OR contains(c.text, f.text)) AND length(c.text) <= length(f.text) THEN f.kept ELSE c.turn END,
CASE WHEN (contains(f.text, c.text) OR contains(c.text, f.text)) AND length(c.text) <= length(f.text) THEN f.text ELSE c.text END FROM f JOIN c ON c.conv_id = f.conv_id AND c.turn = f.turn + 1),
x AS (SELECT *, lead(kept) OVER (PARTITION BY conv_id ORDER BY turn) AS nk, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS nt FROM f)
SELECT conv_id, CAST(kept AS BIGINT) AS turn FROM x WHERE nk IS NULL OR (nk <> kept AND NOT (contains(text, nt) OR contains(nt, text)))""")
def adjacent_repeat_filter(spark, d):
    c = table(spark, d, "conversations")
    t = F.col("turn").cast("double")
    segments = c.select(F.col("turn").cast("long").alias("id"), "conv_id", t.alias("t0"), (t + 0.5).alias("t1"), F.coalesce("text", F.lit("")).alias("text"))
    return fo.drop_adjacent_repeats(segments, ["conv_id"], 0.5).select("conv_id", F.col("id").alias("turn"))


@query(f"""WITH {{S}}, r AS (SELECT *, lag(t1) OVER w AS e, lag(speaker) OVER w AS who FROM s WINDOW w AS ({ORD})),
i AS (SELECT *, sum(CASE WHEN e IS NULL OR speaker <> who OR t0 - e < -60 OR t0 - e > 43200 THEN 1 ELSE 0 END) OVER ({ORD} ROWS UNBOUNDED PRECEDING) AS k FROM r),
g AS (SELECT media_id, any_value(speaker) AS speaker, count(*) AS words, min(t0) AS t0, max(t1) AS t1 FROM i GROUP BY media_id, k)
SELECT media_id, speaker, words, {MS.format("t0")}, {MS.format("t1")} FROM g""")
def word_event_groups(spark, d):
    return co.word_events(spans(spark, d), M, -60.0, 12 * HOUR).select("media_id", "speaker", "words", *_ms("t0", "t1"))


@query(f"""WITH {{S}}, n AS (SELECT *, lead(t0) OVER ({ORD}) AS n, lead(speaker) OVER ({ORD}) AS who FROM s),
g AS (SELECT id, CASE WHEN n > t1 AND n - t1 <= 7200 AND speaker IS NOT DISTINCT FROM who THEN n - 0.001 ELSE t1 END AS t1 FROM n)
SELECT id, {MS.format("t1")} FROM g""")
def gap_close(spark, d):
    return co.close_gaps(spans(spark, d), M, 2 * HOUR).select("id", *_ms("t1"))


@query("""WITH {S}, r AS (SELECT *, max(t1) OVER (PARTITION BY media_id ORDER BY t0, t1, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS e FROM s),
i AS (SELECT *, sum(CASE WHEN e IS NULL OR t0 >= e THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY t0, t1, id ROWS UNBOUNDED PRECEDING) AS k FROM r),
t AS (SELECT *, row_number() OVER (PARTITION BY media_id, k ORDER BY t0, t1, id) AS n FROM i), f AS (SELECT *, row_number() OVER (PARTITION BY media_id, k, speaker ORDER BY t0, t1, id) AS m FROM t WHERE n <= 2)
SELECT media_id, min(id) AS group_id, count(*) AS tracks, string_agg(speaker, ' | ' ORDER BY t0, t1, id) AS label, CAST(round(min(t0) * 1000) AS BIGINT) AS t0_ms, CAST(round(max(t1) * 1000) AS BIGINT) AS t1_ms FROM f WHERE m = 1 GROUP BY media_id, k HAVING max(n) > 1 AND count(*) > 1""")
def overlap_groups(spark, d):
    return co.overlap_groups(spans(spark, d), M, 2).select("media_id", "group_id", "tracks", "label", *_ms("t0", "t1"))


@query("""WITH {S}, g AS (SELECT media_id, t1 AS g0, lead(t0) OVER (PARTITION BY media_id ORDER BY t0, t1, id) AS g1 FROM s), c AS (SELECT media_id, (g0 + g1) / 2 AS cut FROM g WHERE g1 - g0 >= 86400),
e AS (SELECT media_id, min(t0) AS a, max(t1) AS b FROM s GROUP BY media_id),
p AS (SELECT media_id, a AS x FROM e UNION ALL SELECT * FROM c), n AS (SELECT p.media_id, x, lead(x) OVER (PARTITION BY p.media_id ORDER BY x) AS y, a, b FROM p JOIN e ON e.media_id = p.media_id)
SELECT media_id, CAST(round(greatest(a, x - 600) * 1000) AS BIGINT) AS c0_ms, CAST(round(CASE WHEN y IS NULL THEN b ELSE least(b, y + 600) END * 1000) AS BIGINT) AS c1_ms FROM n""")
def macro_chunks(spark, d):
    return co.macro_chunks(spans(spark, d), M, 24 * HOUR, 600.0).select("media_id", *_ms("c0", "c1"))


@query(f"""WITH {{S}}, a AS (SELECT *, avg(value) OVER ({ORD} ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING) AS before, avg(value) OVER ({ORD} ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS ahead FROM s),
d AS (SELECT *, row_number() OVER ({ORD}) AS k FROM a), f AS (SELECT *, k - row_number() OVER (PARTITION BY media_id ORDER BY k) AS run FROM d WHERE before - ahead > 5)
SELECT media_id, CAST(min(k) AS INTEGER) AS first_row, count(*) AS length FROM f GROUP BY media_id, run HAVING count(*) >= 2""")
def switch_runs(spark, d):
    return co.drop_runs(spans(spark, d), M, "value", 5.0, 2)


@query("""WITH {S}, c AS (SELECT a.id, b.t0 AS t, b.speaker FROM s a JOIN s b ON a.media_id = b.media_id AND a.id <> b.id AND a.t0 < b.t1 AND b.t0 < a.t1)
SELECT id, count(DISTINCT speaker) AS speakers, count(*) AS turns FROM c GROUP BY id HAVING count(DISTINCT speaker) >= 2""")
def multi_speaker_spans(spark, d):
    s = spans(spark, d)
    pairs = iv.overlap_join(s, s, M, 2 * HOUR, extra=F.col("id") != F.col("r_id"))
    return pairs.groupBy("id").agg(F.count_distinct("r_speaker").alias("speakers"), F.count(F.lit(1)).alias("turns")).where("speakers >= 2")


@query(f"""WITH {{S}}, n AS (SELECT *, lead(id) OVER ({ORD}) AS r, lead(t0) OVER ({ORD}) AS r0, lead(t1) OVER ({ORD}) AS r1 FROM s), x AS (SELECT * FROM n WHERE r IS NOT NULL AND r0 - t1 BETWEEN 0 AND 14400)
SELECT id, 'left' AS kind, {MS.format("t0")}, CAST(round((t1 + 600) * 1000) AS BIGINT) AS t1_ms FROM x UNION ALL SELECT id, 'right', CAST(round((r0 - 600) * 1000) AS BIGINT), CAST(round(r1 * 1000) AS BIGINT) FROM x
UNION ALL SELECT id, 'fusion', CAST(round((t1 - 600) * 1000) AS BIGINT), CAST(round((r0 + 600) * 1000) AS BIGINT) FROM x WHERE r0 - t1 <= 3600""")
def boundary_windows(spark, d):
    w = W.partitionBy("media_id").orderBy("t0", "t1", "id")
    n = spans(spark, d).withColumn("r0", F.lead("t0").over(w)).withColumn("r1", F.lead("t1").over(w))
    n = n.where((F.col("r0") - F.col("t1")).between(0, 14400))
    row = lambda kind, a, b: F.struct(F.lit(kind).alias("kind"), a.alias("t0"), b.alias("t1"))
    fusion = F.when(F.col("r0") - F.col("t1") <= 3600, row("fusion", F.col("t1") - 600, F.col("r0") + 600))
    windows = F.array_compact(F.array(row("left", F.col("t0"), F.col("t1") + 600), row("right", F.col("r0") - 600, F.col("r1")), fusion))
    return n.select("id", F.inline(windows)).select("id", "kind", *_ms("t0", "t1"))
