"""Queries that make one record of many: words of windows, segments, groups of events; and groups projected onto candidates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import projection as pj
from ..operators import union as un
from ..sources.tables import spans
from .assembly import WORDS, _words
from .registry import MS, M, _ms, _of, query

#: Words of two windows: the second one repeats half of the first one's, a little later, with confidences of its own.
WINDOWS = f"""{WORDS}, v AS (SELECT media_id, turn, 0 AS win, 'a' || id AS id, t0, t1, text, (k * 7 % 10) / 10 AS confidence, CASE WHEN k % 3 > 0 THEN 'en' ELSE '' END AS language FROM w
UNION ALL SELECT media_id, turn, 1, 'b' || id, t0 + 0.03::DOUBLE, t1 + CASE WHEN k % 5 = 0 THEN 0.2 ELSE 0.03 END::DOUBLE, text, (k * 3 % 10) / 10, CASE WHEN k % 8 = 0 THEN 'fr' WHEN k % 4 > 0 THEN 'EN' ELSE '' END FROM w WHERE k % 6 >= 3),
o AS (SELECT *, lower(regexp_replace(text, '\\s+', '', 'g')) AS norm FROM v),
o2 AS (SELECT *, coalesce(t0 - max(t1) OVER (PARTITION BY media_id, norm ORDER BY t0, t1, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > 0.08::DOUBLE, false) AS fresh FROM o),
o3 AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY media_id, norm ORDER BY t0, t1, id) AS isl FROM o2),
it AS (SELECT media_id, norm, isl, row_number() OVER (PARTITION BY media_id, norm, isl ORDER BY t0, t1, id) AS rn, {{'id': id, 't0': t0, 't1': t1, 'conf': confidence, 'lang': lower(language)}} AS x FROM o3),
r AS (SELECT media_id, norm, isl, rn, [x] AS kept, list_filter([{{'id': x.id, 'to': x.id}}], lambda g: false) AS gone FROM it WHERE rn = 1 UNION ALL
SELECT media_id, norm, isl, rn, CASE WHEN old IS NULL THEN list_append(kept, x) WHEN wins THEN list_append(list_filter(kept, lambda k: k.id <> old.id), x) ELSE kept END,
CASE WHEN old IS NULL THEN gone WHEN wins THEN list_append(list_transform(gone, lambda g: {{'id': g.id, 'to': CASE WHEN g.to = old.id THEN x.id ELSE g.to END}}), {{'id': old.id, 'to': x.id}}) ELSE list_append(gone, {{'id': x.id, 'to': old.id}}) END
FROM (SELECT *, coalesce(x.conf > old.conf OR (x.conf = old.conf AND (x.t1 - x.t0 > old.t1 - old.t0 OR (x.t1 - x.t0 = old.t1 - old.t0 AND length(x.id) < length(old.id)))), false) AS wins FROM (
SELECT it.*, kept, gone, list_filter(kept, lambda k: least(k.t1, it.x.t1) - greatest(k.t0, it.x.t0) >= -0.08::DOUBLE AND least(k.t1, it.x.t1) - greatest(k.t0, it.x.t0) >= least(k.t1 - k.t0, it.x.t1 - it.x.t0) * 0.5::DOUBLE - 0.08::DOUBLE
AND (k.lang = '' OR it.x.lang = '' OR k.lang = it.x.lang))[1] AS old FROM r JOIN it ON it.media_id = r.media_id AND it.norm = r.norm AND it.isl = r.isl AND it.rn = r.rn + 1))),
z AS (SELECT media_id, norm, isl, arg_max(kept, rn) AS kept, arg_max(gone, rn) AS gone FROM r GROUP BY ALL),
kept AS (SELECT media_id, unnest(kept).id AS id FROM z), gone AS (SELECT media_id, unnest(gone) AS g FROM z)"""


def _windows(spark, d):
    w, k = _words(spark, d), F.col("k")
    a = w.select("media_id", "turn", F.lit(0).alias("win"), F.concat(F.lit("a"), "id").alias("id"), "t0", "t1", "text", (k * 7 % 10 / 10).alias("confidence"), F.when(k % 3 > 0, "en").otherwise("").alias("language"))
    b = w.where(k % 6 >= 3).select(
        "media_id", "turn", F.lit(1).alias("win"), F.concat(F.lit("b"), "id").alias("id"), (F.col("t0") + 0.03).alias("t0"), (F.col("t1") + F.when(k % 5 == 0, 0.2).otherwise(0.03)).alias("t1"), "text", (k * 3 % 10 / 10).alias("confidence"),
        F.when(k % 8 == 0, "fr").when(k % 4 > 0, "EN").otherwise("").alias("language"),
    )
    return a.unionByName(b)


@query(f"WITH RECURSIVE {WINDOWS} SELECT media_id, id, NULL AS canonical FROM kept UNION ALL SELECT media_id, g.id, g.to FROM gone")
def union_words(spark, d):
    """Words that stay, and the others beside the word that stands for them."""
    kept, aliases = un.union_words(_windows(spark, d), M)
    return kept.select("media_id", "id", F.lit(None).cast("string").alias("canonical")).unionByName(aliases)


@query(f"""WITH RECURSIVE {WINDOWS}, s AS (SELECT media_id, turn * 2 + win AS n, 's' || turn AS segment, v.id FROM v), cn AS (SELECT DISTINCT s.media_id, n, segment, coalesce(g.to, s.id) AS id FROM s LEFT JOIN gone ON s.media_id = gone.media_id AND s.id = g.id),
l AS (SELECT cn.media_id, n, segment, list(v.id ORDER BY v.t0, v.t1, v.id) AS words, min(v.t0) AS t0, max(v.t1) AS t1 FROM cn JOIN v ON cn.media_id = v.media_id AND cn.id = v.id GROUP BY ALL),
q AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY media_id, words ORDER BY n) = 1), k AS (SELECT *, row_number() OVER (PARTITION BY media_id, segment ORDER BY n) AS a FROM q)
SELECT media_id, n, CASE WHEN a = 1 THEN segment ELSE segment || ':dup' || a END AS id, len(words) AS n_words, {MS.format("t0")}, {MS.format("t1")} FROM k""")
def rewire_segments(spark, d):
    v = _windows(spark, d)
    segments = v.groupBy("media_id", (F.col("turn") * 2 + F.col("win")).alias("n"), F.format_string("s%d", "turn").alias("id")).agg(F.collect_list("id").alias("words"))
    s = un.rewire_segments(segments, *un.union_words(v, M), M)
    return s.select("media_id", "n", "id", F.size("words").alias("n_words"), *_ms("t0", "t1"))


GROUPS = """n AS (SELECT *, (row_number() OVER (PARTITION BY media_id ORDER BY t0, t1, id) - 1) // 3 AS grp, CASE WHEN id % 4 > 0 THEN id % 3 END AS who, CASE WHEN id % 5 = 0 THEN 'confirmed' ELSE 'guess' END AS status FROM s)"""


@query(f"""WITH {{S}}, {GROUPS}, c AS (SELECT media_id, grp, who, count(*) AS k FROM n WHERE who IS NOT NULL GROUP BY ALL), m AS (SELECT media_id, grp, max_by(who, (k, -who)) AS most FROM c GROUP BY ALL),
g AS (SELECT media_id, grp, list(id ORDER BY t0, id) AS ids, min(t0) AS t0, arg_max(t1, (t0, id)) AS t1, first(who ORDER BY t0, id) FILTER (who IS NOT NULL AND status = 'confirmed') AS sure, first(status ORDER BY t0, id) AS st, min(CASE WHEN id % 2 = 0 THEN t0 END) AS p0, max(CASE WHEN id % 3 > 0 THEN t1 END) AS p1,
string_agg('e' || id, ' ' ORDER BY t0, id) AS text, len(list_distinct(flatten(list([id, id // 2])))) AS n_words FROM n GROUP BY media_id, grp)
SELECT media_id, grp, ids[1] AS id, text, CAST(coalesce(sure, most) AS INTEGER) AS speaker, CASE WHEN sure IS NOT NULL THEN 'confirmed' WHEN most IS NOT NULL THEN st ELSE 'unknown' END AS status, {MS.format("t0")}, {MS.format("t1")}, {MS.format("p0")}, {MS.format("p1")}, n_words, CAST(2 * len(ids) AS BIGINT) AS n_spans
FROM g LEFT JOIN m USING (media_id, grp)""")
def merge_groups(spark, d):
    i = F.col("id")
    s = spans(spark, d).withColumn("grp", F.floor((F.row_number().over(W.partitionBy("media_id").orderBy("t0", "t1", "id")) - 1) / 3).cast("long"))
    one = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    e = s.select(
        "media_id", "grp", "id", "t0", "t1", F.format_string("e%d", "id").alias("text"), F.when(i % 4 > 0, (i % 3).cast("int")).alias("speaker"), F.when(i % 5 == 0, "confirmed").otherwise("guess").alias("status"),
        F.when(i % 2 == 0, F.col("t0")).alias("p0"), F.when(i % 3 > 0, F.col("t1")).alias("p1"), F.array(i, F.floor(i / 2).cast("long")).alias("word_ids"), F.array(one(F.col("t0"), F.col("t1")), one(F.col("t0"), F.col("t1"))).alias("spans"),
    )
    g = un.merge_groups(e, ["media_id", "grp"])
    return g.select("media_id", "grp", "id", "text", "speaker", "status", *_ms("t0", "t1", "p0", "p1"), F.size("word_ids").alias("n_words"), F.size("spans").cast("long").alias("n_spans"))


PROJECTED = """g AS (SELECT id, media_id, row_number() OVER (PARTITION BY media_id ORDER BY t0, t1, id) AS n, t0, t1, CASE WHEN id % 3 > 0 THEN t0 + 30 ELSE t0 END AS a, t1 AS z, CASE WHEN id % 5 > 0 THEN id % 2 END AS who, CASE WHEN id % 4 > 0 THEN id % 3 END AS region, id % 11 = 0 AS sb, id % 7 = 0 AS sa FROM s WHERE speaker = 'click'),
st AS (SELECT g.media_id, n, arg_min({'at': c.t0, 'id': 's' || c.id, 'c': c.value / 50}, (abs(c.t0 - a), c.t0, 's' || c.id)) AS s FROM g JOIN s c ON g.media_id = c.media_id AND c.speaker = 'view' AND abs(c.t0 - a) <= 20000 GROUP BY ALL),
en AS (SELECT g.media_id, n, arg_min({'at': c.t1, 'id': 'e' || c.id, 'c': c.value / 50}, (abs(c.t1 - z), c.t1, 'e' || c.id)) AS e FROM g JOIN s c ON g.media_id = c.media_id AND c.speaker = 'view' AND abs(c.t1 - z) <= 20000 GROUP BY ALL),
j AS (SELECT g.*, s, e, e.at - s.at AS long, n < max(n) OVER (PARTITION BY g.media_id) AND coalesce(who = lead(who) OVER o, true) AND coalesce(region = lead(region) OVER o, true) AND NOT (sa OR coalesce(lead(sb) OVER o, false)) AS joins
FROM g LEFT JOIN st USING (media_id, n) LEFT JOIN en USING (media_id, n) WINDOW o AS (PARTITION BY g.media_id ORDER BY n)),
k AS (SELECT *, concat_ws(';', CASE WHEN long <= 0 THEN 'inverted' END, CASE WHEN long > 0 AND long > 15000 THEN 'too_long' END, CASE WHEN s IS NULL THEN 'no_start' END, CASE WHEN e IS NULL THEN 'no_end' END) AS warnings FROM j),
p AS (SELECT *, CASE WHEN warnings = '' THEN 'accepted' WHEN joins THEN 'merged' ELSE 'fallback' END AS state FROM k)"""


def _projected(spark, d):
    i = F.col("id")
    n = F.row_number().over(W.partitionBy("media_id").orderBy("t0", "t1", "id"))
    g = _of(spark, d, "click").withColumn("n", n)
    g = g.select(
        "media_id", "n", "id", "t0", "t1", F.when(i % 3 > 0, F.col("t0") + 30).alias("p0"), F.lit(None).cast("double").alias("p1"), F.when(i % 5 > 0, i % 2).alias("speaker"), F.when(i % 4 > 0, i % 3).alias("region"),
        (i % 11 == 0).alias("split_before"), (i % 7 == 0).alias("split_after"),
    )
    v = _of(spark, d, "view")
    edges = [v.select("media_id", F.concat(F.lit(k), F.col("id").cast("string")).alias("id"), F.col(c).alias("at"), (F.col("value") / 50).alias("confidence")) for k, c in (("s", "t0"), ("e", "t1"))]
    return pj.project_boundaries(g, *edges, M, longest=15_000.0, most=20_000.0)


@query(f"""WITH {{S}}, {PROJECTED}, q AS (SELECT *, state = 'fallback' AS f FROM p) SELECT media_id, n, CASE WHEN f THEN 'fallback' ELSE coalesce(s.id, 'merge-fallback') END AS start_id, CASE WHEN f THEN 'fallback' ELSE coalesce(e.id, 'merge-fallback') END AS end_id,
CAST(round(CASE WHEN f THEN a ELSE coalesce(s.at, a) END * 1000) AS BIGINT) AS start_ms, CAST(round(CASE WHEN f THEN z ELSE coalesce(e.at, z) END * 1000) AS BIGINT) AS end_ms,
round(CASE WHEN f THEN 0 ELSE greatest(0, least(1, coalesce(s.c, 0))) END, 6) AS start_confidence, 'proposed;projected;' || state AS states, warnings FROM q""")
def project_boundaries(spark, d):
    p = _projected(spark, d)
    return p.select("media_id", "n", "start_id", "end_id", *_ms("start", "end"), F.round("start_confidence", 6).alias("start_confidence"), F.array_join("states", ";").alias("states"), F.array_join("warnings", ";").alias("warnings"))


@query(f"""WITH {{S}}, {PROJECTED} SELECT media_id, n, CASE WHEN state <> 'merged' THEN state WHEN id % 2 = 0 THEN 'one_repair' ELSE 'fallback' END AS state,
CASE WHEN state = 'merged' AND id % 2 > 0 THEN concat_ws(';', warnings, 'repair_failed') ELSE warnings END AS warnings,
CAST(round(CASE WHEN state = 'merged' AND id % 2 = 0 THEN t0 + 5 WHEN state = 'fallback' THEN a ELSE coalesce(s.at, a) END * 1000) AS BIGINT) AS start_ms FROM p""")
def repair_projections(spark, d):
    p = _projected(spark, d)
    fixes = p.where("id % 2 = 0").select("media_id", "n", (F.col("t0") + 5).alias("start"), (F.col("t1") + 5).alias("end"))
    r = pj.repair_projections(p, fixes, M)
    return r.select("media_id", "n", "state", F.array_join("warnings", ";").alias("warnings"), *_ms("start"))
