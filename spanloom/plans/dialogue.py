"""Queries over timed words, pauses and fragments; the SQL walks the rows one by one where the operators use windows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import dialogue as di
from ..operators import feedback as fb
from ..operators import words as wo
from ..sources.tables import spans, table
from .registry import HOUR, M, _ms, _of, query

TURN = ["conv_id", "turn"]
BARE = r"[^\t\n\x0B\f\r ]+"
SCALE = 36000.0

WORDS = rf"""l AS (SELECT conv_id, turn, regexp_extract_all(text, '{BARE}') AS l FROM conversations WHERE text IS NOT NULL),
k AS (SELECT conv_id, turn, unnest(range(len(l))) AS pos, l FROM l),
w AS (SELECT conv_id, turn, pos, l[pos + 1] AS word, length(l[pos + 1]) AS n, (450 * pos + 250 * (pos // 9) + 160 * (pos // 5)) / CAST(1000 AS DOUBLE) AS t0,
(450 * pos + 250 * (pos // 9) + 160 * (pos // 5) + 300) / CAST(1000 AS DOUBLE) AS t1, (CASE WHEN (pos // 4) % 3 = 2 THEN 30 ELSE 90 END + length(l[pos + 1]) % 5) / CAST(100 AS DOUBLE) AS conf FROM k)"""


def _words(spark, d):
    """Words of the conversations with made-up times and confidences."""
    found = table(spark, d, "conversations").select(*TURN, F.posexplode(F.regexp_extract_all("text", F.lit(BARE), F.lit(0))).alias("pos", "word"))
    ms = F.col("pos") * 450 + F.floor(F.col("pos") / 9) * 250 + F.floor(F.col("pos") / 5) * 160
    low = F.when(F.floor(F.col("pos") / 4) % 3 == 2, 30).otherwise(90)
    return found.select(*TURN, "pos", "word", (ms / 1000.0).alias("t0"), ((ms + 300) / 1000.0).alias("t1"), ((low + F.length("word") % 5) / 100.0).alias("conf"))


@query(rf"""WITH RECURSIVE {WORDS}, e AS (SELECT conv_id, turn, latin > cjk AS latin, CASE WHEN cjk > 0.5 * size THEN 40 ELSE 84 END AS top FROM (SELECT conv_id, turn, sum(n) AS size,
sum(len(regexp_extract_all(word, '[A-Za-z]'))) AS latin, sum(len(regexp_extract_all(word, '[\x{{4E00}}-\x{{9FFF}}]'))) AS cjk FROM w GROUP BY ALL)),
r AS (SELECT conv_id, turn, pos, 0 AS piece, t0 AS s, n AS chars, word AS said, t1 AS was FROM w WHERE pos = 0
UNION ALL SELECT conv_id, turn, pos, piece + CAST(cut AS INTEGER), CASE WHEN cut THEN t0 ELSE s END, CASE WHEN cut THEN n ELSE chars + n END, word, t1 FROM (
SELECT w.*, r.piece, r.s, r.chars, regexp_matches(said, '[.!?！？。]$')
OR (latin AND soft AND was - s >= 1.15 AND (trim(lower(w.word), '"''([{{“‘') IN ('but', 'because', 'either', 'for', 'if', 'i''m', 'it''s', 'once', 'or', 'so', 'that', 'they''re', 'you', 'you''ll')
OR (was - s >= 4.5 AND chars >= 24))) OR w.t1 - s > CASE WHEN latin THEN 4.5 ELSE 5 END OR chars + w.n > top
OR ((w.t0 - was < 0 OR w.t0 - was > 0.35) AND NOT (latin AND w.t0 - was <= 0.5 AND soft)) OR (latin AND w.t0 - was >= 0.3 AND was - s >= 2 AND NOT soft) AS cut
FROM (SELECT *, regexp_matches(said, '[,;；]$') AS soft FROM r) r JOIN w ON w.conv_id = r.conv_id AND w.turn = r.turn AND w.pos = r.pos + 1 JOIN e ON e.conv_id = w.conv_id AND e.turn = w.turn))
SELECT conv_id, turn, piece, CAST(round(min(w.t0) * 1000) AS BIGINT) AS t0_ms, CAST(round(max(w.t1) * 1000) AS BIGINT) AS t1_ms, count(*) AS n_words, string_agg(word, ' ' ORDER BY pos) AS text
FROM r JOIN w USING (conv_id, turn, pos) GROUP BY conv_id, turn, piece""")
def word_safe_segments(spark, d):
    return wo.segment_words(_words(spark, d), TURN).select(*TURN, "piece", *_ms("t0", "t1"), F.col("n_words").cast("long").alias("n_words"), "text")


FALLS = f"""{WORDS}, f AS (SELECT *, count(*) OVER (PARTITION BY conv_id, turn) AS size, avg(conf) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN 2 PRECEDING AND 1 PRECEDING)
- avg(conf) OVER (PARTITION BY conv_id, turn ORDER BY pos ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS fell FROM w),
g AS (SELECT conv_id, turn, 0 AS pos, false AS low, 0 AS since, -1 AS hit, size FROM f WHERE pos = 0 AND size >= 4
UNION ALL SELECT f.conv_id, f.turn, f.pos, CASE WHEN low THEN NOT fell <= 0.15 ELSE fell > 0.3 END, CASE WHEN NOT low AND fell > 0.3 THEN f.pos ELSE since END,
CASE WHEN low AND fell <= 0.15 AND f.pos - since >= 2 THEN since ELSE -1 END, g.size FROM g JOIN f ON f.conv_id = g.conv_id AND f.turn = g.turn AND f.pos = g.pos + 1),
h AS (SELECT conv_id, turn, hit AS pos FROM g WHERE hit >= 0 UNION ALL SELECT conv_id, turn, since FROM g WHERE pos = size - 1 AND low AND size - since >= 2)"""


@query(f"WITH RECURSIVE {FALLS} SELECT conv_id, turn, CAST(pos AS INTEGER) AS pos FROM h")
def language_switches(spark, d):
    return wo.language_switches(_words(spark, d), TURN).select(*TURN, F.col("pos").cast("int").alias("pos"))


@query(f"""WITH RECURSIVE {FALLS}, x AS (SELECT h.conv_id, h.turn, h.pos AS sw, unnest(range(greatest(h.pos - 3, 0), h.pos + 4)) AS pos FROM h),
y AS (SELECT x.*, w.t0, w.t1, count(*) OVER p AS c, min(w.t0) OVER p AS a, max(w.t1) OVER p AS b, row_number() OVER (PARTITION BY x.conv_id, x.turn, sw ORDER BY x.pos) - 1 AS j
FROM x JOIN w ON w.conv_id = x.conv_id AND w.turn = x.turn AND w.pos = x.pos WINDOW p AS (PARTITION BY x.conv_id, x.turn, sw)),
z AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn, pos ORDER BY sw DESC) AS k FROM y WHERE c > 1)
SELECT w.conv_id, w.turn, CAST(w.pos AS INTEGER) AS pos, CAST(round(1000 * coalesce(a + j / (c - 1) * (b - a) * 0.9, w.t0)) AS BIGINT) AS t0_ms,
CAST(round(1000 * coalesce(a + (j / (c - 1) + 1 / c) * (b - a) * 0.9, w.t1)) AS BIGINT) AS t1_ms, z.pos IS NOT NULL AS smoothed
FROM w LEFT JOIN z ON w.conv_id = z.conv_id AND w.turn = z.turn AND w.pos = z.pos AND z.k = 1""")
def switch_smoothing(spark, d):
    w = _words(spark, d)
    return wo.smooth_switches(w, wo.language_switches(w, TURN), TURN).select(*TURN, F.col("pos").cast("int").alias("pos"), *_ms("t0", "t1"), "smoothed")


@query("""WITH {S}, p AS (SELECT id, media_id, t0 AS t FROM s WHERE speaker = 'click'),
c AS (SELECT p.id, t, b.t0 AS ed, b.speaker || b.id AS label, b.speaker AS source FROM p JOIN s b ON p.media_id = b.media_id AND b.speaker <> 'click' AND abs(b.t0 - t) <= 86400
UNION ALL SELECT id, t, t, 'asr', 'asr' FROM p), g AS (SELECT id, t, ed, min(label) AS label, count(DISTINCT source) AS n FROM c GROUP BY ALL),
h AS (SELECT *, greatest(0, least(1, 1 - abs(ed - t) / 86400)) * CAST(0.28 AS DOUBLE) + CAST(0.5 AS DOUBLE) * CAST(0.16 AS DOUBLE) + least(1, n / 3) * CAST(0.1 AS DOUBLE) AS score, ed = t OR ed > t + 43200 AS bad FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY bad, score DESC, ed, label DESC) AS k, count(*) FILTER (WHERE bad) OVER (PARTITION BY id) AS n_rejected FROM h)
SELECT id, NOT bad AS accepted, CAST(round(1000 * CASE WHEN bad THEN t ELSE ed END) AS BIGINT) AS at_ms, CASE WHEN NOT bad THEN label END AS label, round(CASE WHEN bad THEN 0 ELSE score END, 6) AS confidence, n_rejected FROM k WHERE k = 1""")
def edge_arbitration(spark, d):
    points = _of(spark, d, "click").select("id", *M, F.col("t0").alias("t"))
    edges = _of(spark, d, "click", True).select(*M, F.col("t0").alias("at"), F.concat("speaker", F.col("id").cast("string")).alias("label"), F.col("speaker").alias("source"))
    c = wo.edge_candidates(points, edges, M, 24 * HOUR)
    score = wo.edge_score(1 - F.abs(F.col("at") - F.col("t")) / (24 * HOUR), source_consistency=F.col("sources") / 3)
    fault = F.when(F.col("at") == F.col("t"), "own time").when(F.col("at") > F.col("t") + 12 * HOUR, "late")
    return wo.arbitrate(c.withColumn("score", score).withColumn("rejected", fault), ["id"]).select("id", "accepted", *_ms("at"), "label", F.round("confidence", 6).alias("confidence"), "n_rejected")


@query(f"""WITH RECURSIVE {{S}}, n AS (SELECT id, media_id, row_number() OVER o AS i, lead(t0) OVER o / {SCALE}::DOUBLE - t1 / {SCALE}::DOUBLE AS gap FROM s WINDOW o AS (PARTITION BY media_id ORDER BY t0, t1, id)),
m AS (SELECT media_id, coalesce(median(gap) FILTER (WHERE gap > 0), 0.3) AS mid FROM n GROUP BY media_id),
q AS (SELECT n.*, coalesce(gap >= least(0.5, greatest(0.08, mid)), false) AS switch, coalesce(gap > 0 AND gap <= greatest(0.03, mid * 0.3), false) AS back FROM n JOIN m USING (media_id)),
r AS (SELECT media_id, i, id, switch, back, 0 AS cur, 1 AS nxt, CAST(NULL AS INTEGER) AS prev, CAST(NULL AS INTEGER) AS held FROM q WHERE i = 1
UNION ALL SELECT q.media_id, q.i, q.id, q.switch, q.back, CASE WHEN r.switch THEN nxt WHEN r.back AND prev IS NOT NULL THEN prev ELSE cur END, CASE WHEN r.switch THEN nxt + 1 ELSE nxt END,
CASE WHEN r.switch THEN coalesce(held, cur) WHEN r.back AND prev IS NOT NULL THEN cur ELSE prev END, CASE WHEN r.switch THEN CASE WHEN held IS NULL THEN cur END ELSE held END
FROM r JOIN q ON q.media_id = r.media_id AND q.i = r.i + 1) SELECT id, CAST(cur AS BIGINT) AS speaker_no FROM r""")
def gap_speakers(spark, d):
    s = spans(spark, d).withColumn("t0", F.col("t0") / SCALE).withColumn("t1", F.col("t1") / SCALE)
    return di.gap_speakers(s, M).select("id", "speaker_no")


@query("""WITH RECURSIVE {S}, p AS (SELECT *, row_number() OVER o AS i, count(*) OVER (PARTITION BY media_id) AS c, coalesce(t0 - lag(t1) OVER o > 259200, false) AS hard FROM s WINDOW o AS (PARTITION BY media_id ORDER BY t0, t1, id)),
z AS (SELECT a.media_id, a.i, a.id, a.t0, least(10, a.c - a.i + 1, coalesce(min(CASE WHEN b.hard THEN b.i - a.i END), 10), coalesce(min(CASE WHEN x.t1 - a.t0 >= 432000 THEN b.i - a.i END), 10)) AS n
FROM p a LEFT JOIN p b ON a.media_id = b.media_id AND b.i BETWEEN a.i + 1 AND a.i + 10 LEFT JOIN p x ON x.media_id = a.media_id AND x.i = b.i - 1 GROUP BY a.media_id, a.i, a.id, a.t0, a.c),
r AS (SELECT media_id, i, n, 1 AS k FROM z WHERE i = 1 UNION ALL SELECT z.media_id, z.i, z.n, k + 1 FROM r JOIN z ON z.media_id = r.media_id AND z.i = r.i + greatest(1, r.n - 1))
SELECT r.media_id, CAST(k AS INTEGER) AS "window", a.id AS first, b.id AS last, CAST(n AS INTEGER) AS n, CAST(round(a.t0 * 1000) AS BIGINT) AS w0_ms, CAST(round(b.t1 * 1000) AS BIGINT) AS w1_ms
FROM r JOIN p a ON a.media_id = r.media_id AND a.i = r.i JOIN p b ON b.media_id = r.media_id AND b.i = r.i + n - 1""")
def fragment_windows(spark, d):
    w = W.partitionBy(*M).orderBy("t0", "t1", "id")
    s = spans(spark, d).withColumn("hard", F.coalesce(F.col("t0") - F.lag("t1").over(w) > 72 * HOUR, F.lit(False)))
    return di.fragment_windows(s, M, 10, 120 * HOUR).select(*M, "window", "first", "last", "n", *_ms("w0", "w1"))


@query("""WITH c AS (SELECT l_suppkey, count(*) AS bins, count(*) FILTER (WHERE l_returnflag <> 'N') AS covered, count(*) FILTER (WHERE l_discount = 0.1 AND l_tax = 0) AS noise,
count(*) FILTER (WHERE l_linestatus = 'F') AS acc, count(*) FILTER (WHERE l_linestatus = 'O') AS rej, count(*) FILTER (WHERE l_quantity > 45) AS bad, count(*) FILTER (WHERE l_quantity = 50) AS failed,
count(*) FILTER (WHERE l_linenumber = 7) AS fallbacks, count(*) FILTER (WHERE l_quantity = 49 AND l_tax = 0.08) AS ov, count(*) FILTER (WHERE l_quantity = 1 AND l_tax = 0.08) AS trimmed FROM lineitem GROUP BY ALL),
i AS (SELECT *, CASE WHEN l_suppkey % 4 = 0 THEN NULL ELSE round(covered / bins, 3) END AS ca, CAST(l_suppkey % 4 = 0 OR covered / bins < 0.5 AS INTEGER) + CAST(noise > 0 AS INTEGER) + CAST(acc / greatest(acc + rej, 1) < 0.5 AS INTEGER) AS ia,
CAST(failed > 0 AS INTEGER) + CAST(fallbacks > 0 AS INTEGER) AS im, CAST(l_suppkey % 3 = 0 AS INTEGER) AS isp, CAST(ov > 0 AS INTEGER) + CAST(trimmed > 0 AS INTEGER) AS ist FROM c),
q AS (SELECT l_suppkey, ia, im, isp, ist, round(greatest(1 - ia * 0.15, coalesce(ca, 0) * 0.8), 3) AS acoustic, round(greatest(1 - im * 0.15, round(1 - bad / bins, 3) * 0.8), 3) AS semantic,
round(greatest(1 - isp * 0.15, CASE WHEN isp = 1 THEN 0.72 ELSE 0.8 END), 3) AS speaker, round(greatest(1 - ist * 0.15, (1 - ist * 0.2) * 0.8), 3) AS structure FROM i)
SELECT l_suppkey, CAST(acoustic AS DOUBLE) AS acoustic, CAST(semantic AS DOUBLE) AS semantic, CAST(speaker AS DOUBLE) AS speaker, CAST(structure AS DOUBLE) AS structure, ia + im + isp + ist AS issues,
CASE WHEN acoustic >= 0.85 THEN 'excellent' WHEN acoustic >= 0.7 THEN 'good' WHEN acoustic >= 0.5 THEN 'fair' ELSE 'poor' END AS acoustic_grade FROM q""")
def quality_report(spark, d):
    n = lambda c: F.count_if(c)
    q, x, tax, key = F.col("l_quantity"), F.col("l_linestatus"), F.col("l_tax"), F.col("l_suppkey")
    c = table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("bins"), n(F.col("l_returnflag") != "N").alias("covered"), n((F.col("l_discount") == 0.1) & (tax == 0)).alias("noise_warnings"),
        n(x == "F").alias("edges_accepted"), n(x == "O").alias("edges_rejected"), F.count(F.lit(1)).alias("words"), n(q > 45).alias("words_rejected"), F.count(F.lit(1)).alias("windows"),
        n(q == 50).alias("windows_failed"), F.count(F.lit(1)).alias("groups"), n(F.col("l_linenumber") == 7).alias("fallbacks"), n((q == 49) & (tax == 0.08)).alias("overlaps"), n((q == 1) & (tax == 0.08)).alias("trimmed"),
    )
    c = c.withColumn("covered", F.when(key % 4 != 0, F.col("covered"))).withColumn("speakers_retained", F.when(key % 3 == 0, 0.9).otherwise(1.0)).withColumn("removed", F.lit(0))
    dims = ["acoustic", "semantic", "speaker", "structure"]
    issues = sum((F.size(f"{k}_issues") for k in dims), F.lit(0))
    return fb.quality_report(c).select("l_suppkey", *dims, issues.alias("issues"), "acoustic_grade")


def _turns(spark, d):
    """Turns of the conversations as segments with made-up times."""
    t = F.col("turn")
    ms = t * 3000 + F.floor(t / 3) * 2500
    return table(spark, d, "conversations").select(F.col("conv_id").alias("media_id"), t.alias("id"), "role", "text", (ms / 1000.0).alias("t0"), ((ms + 2900 - t % 4 * 150) / 1000.0).alias("t1"))


@query(rf"""WITH c AS (SELECT conv_id AS media_id, turn AS id, text, turn * 3000 + turn // 3 * 2500 AS a, turn * 3000 + turn // 3 * 2500 + 2900 - turn % 4 * 150 AS z FROM conversations),
f AS (SELECT *, regexp_matches(coalesce(text, ''), '{di.QUESTION}') OR regexp_matches(coalesce(text, ''), '{di.ADDRESS.removeprefix("(?U)")}') AS asks, regexp_matches(ltrim(coalesce(text, '')), '{di.REPLY}') AS reply, regexp_matches(coalesce(text, ''), '{di.SENTENCE_END}') AS ends FROM c),
l AS (SELECT *, a / 1000 - lag(z / 1000) OVER w AS gap, lag(asks) OVER w AS pa, lag(reply) OVER w AS pr, lag(ends) OVER w AS pe FROM f WINDOW w AS (PARTITION BY media_id ORDER BY a, z, id))
SELECT media_id, id, CAST(sum(CASE WHEN pa OR gap > 10 OR (gap >= 0.25 AND (pe OR reply <> pr)) THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY a, z, id) % 2 AS BIGINT) AS speaker_no FROM l""")
def text_speakers(spark, d):
    return di.text_speakers(_turns(spark, d), M)


@query()
def paragraph_anchors(spark, d):
    """Anchors between the turns of one role and those of the other, by greedy pairing (tests hold it against a loop)."""
    t = _turns(spark, d)
    return di.paragraph_anchors(t.where("role = 'user'"), t.where("role = 'assistant'"), M)
