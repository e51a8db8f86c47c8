"""Queries on events: coordinates, owners and merge predicates, evidence, boundary choices, display times, labels and scores."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import events as ev
from ..operators import coalesce as co
from ..operators import events as op
from ..sources.tables import spans, table
from .registry import HOUR, MS, M, _ms, _of, query


def _along():
    """A recording's events in order."""
    return W.partitionBy("media_id").orderBy("t0", "t1", "id")


@query("""WITH {S}, p AS (SELECT a.id, b.id AS clip FROM s a JOIN s b ON a.media_id = b.media_id AND a.t0 < b.t1 AND b.t0 < a.t1 WHERE a.speaker = 'click' AND b.speaker = 'view')
SELECT id, min(clip) AS clip FROM p GROUP BY id HAVING count(*) = 1""")
def single_owner(spark, d):
    return op.only_owner(_of(spark, d, "click"), _of(spark, d, "view"), M, 6 * HOUR)


@query(f"""WITH {{S}}, o AS (SELECT *, min(t0) OVER (PARTITION BY media_id) AS o, max(t1) OVER (PARTITION BY media_id) AS z FROM s),
g AS (SELECT id, t0 - o AS local, (t0 - o) + o AS t0, CASE WHEN t0 - 3600 >= o THEN t0 - 3600 - o END AS before, CAST((t0 - o) * 16000 AS BIGINT) / CAST(16000 AS DOUBLE) AS grid, t1 > z AS outside FROM o)
SELECT id, outside, {MS.format("local")}, {MS.format("t0")}, {MS.format("before")}, abs(grid - local) < 0.001 AS on_grid FROM g""")
def coordinate_views(spark, d):
    w = W.partitionBy("media_id")
    s = spans(spark, d).withColumn("o", F.min("t0").over(w)).withColumn("z", F.max("t1").over(w))
    local = ev.to_local(F.col("t0"), F.col("o"))
    s = s.select("id", (F.col("t1") > F.col("z")).alias("outside"), local.alias("local"), ev.to_global(local, F.col("o")).alias("t0"), ev.to_local(F.col("t0") - 3600, F.col("o")).alias("before"))
    return s.select("id", "outside", *_ms("local", "t0", "before"), (F.abs(ev.to_seconds(ev.to_sample(F.col("local"))) - F.col("local")) < 0.001).alias("on_grid"))


@query(f"""WITH {{S}}, o AS (SELECT id, t0 - min(t0) OVER w - 3600 AS a, t1 - min(t0) OVER w - 3600 AS b, (max(t1) OVER w - min(t0) OVER w) / 2 AS d FROM s WINDOW w AS (PARTITION BY media_id)),
c AS (SELECT id, b > a AS ok, greatest(0, least(a, d)) AS start, greatest(0, least(b, d)) AS stop FROM o) SELECT id, {MS.format("start")}, {MS.format("stop")} FROM c WHERE ok AND stop > start""")
def clamp_range(spark, d):
    w = W.partitionBy("media_id")
    o = F.min("t0").over(w)
    c = ev.clamped(F.col("a"), F.col("b"), F.col("d"))
    s = spans(spark, d).select("id", (F.col("t0") - o - 3600).alias("a"), (F.col("t1") - o - 3600).alias("b"), ((F.max("t1").over(w) - o) / 2).alias("d"))
    return s.select("id", c.alias("c")).where("c is not null").select("id", F.col("c.start").alias("start"), F.col("c.end").alias("stop")).select("id", *_ms("start", "stop"))


def _owned(spark, d):
    """Events with spans, region, warnings and hard splits that follow from their ids."""
    i, mid = F.col("id"), (F.col("t0") + F.col("t1")) / 2
    clip = lambda k: F.concat(F.lit("c"), (F.col("id") + k) % 3)
    one = lambda a, b, c: F.struct(a.alias("start"), b.alias("end"), c.alias("clip"))
    both = F.array(one(F.col("t0"), mid, clip(0)), one(mid, F.col("t1"), clip(1)))
    event = F.struct(
        "id", F.when(i % 6 == 0, None).otherwise(F.col("speaker")).alias("speaker"), F.col("t0").alias("start"), F.col("t1").alias("end"), F.when(i % 5 == 0, F.filter(both, lambda s: F.lit(False))).otherwise(both).alias("spans"),
        F.when(i % 4 == 0, None).otherwise(i % 2).alias("region"), F.when(i % 7 == 0, "late;speaker_conflict").when(i % 7 == 1, "late").alias("warnings"), (i % 11 == 0).alias("split_before"), (i % 13 == 0).alias("split_after"),
    )
    return spans(spark, d).select("media_id", "id", event.alias("left"), F.lead(event).over(_along()).alias("right")).where("right is not null")


OWNED = """, o AS (SELECT media_id, id, t0, t1, CASE WHEN id % 6 = 0 THEN NULL ELSE speaker END AS sp, CASE WHEN id % 5 = 0 THEN 0 ELSE 2 END AS n, CASE WHEN id % 4 = 0 THEN NULL ELSE id % 2 END AS rg,
id % 7 = 0 AS hard, id % 11 = 0 AS sb, id % 13 = 0 AS sa, (t0 + t1) / 2 AS m, id % 3 AS c1, (id + 1) % 3 AS c2 FROM s),
p AS (SELECT *, lead(id) OVER w AS r_id, lead(t0) OVER w AS r_t0, lead(t1) OVER w AS r_t1, lead(sp) OVER w AS r_sp, lead(n) OVER w AS r_n, lead(rg) OVER w AS r_rg, lead(hard) OVER w AS r_hard, lead(sb) OVER w AS r_sb,
lead(m) OVER w AS r_m, lead(c1) OVER w AS r_c1, lead(c2) OVER w AS r_c2 FROM o WINDOW w AS (PARTITION BY media_id ORDER BY t0, t1, id)),
q AS (SELECT *, list_sort([[t0, m], [m, t1], [r_t0, r_m], [r_m, r_t1]]) AS x FROM p WHERE r_id IS NOT NULL),
k AS (SELECT *, rg IS NOT DISTINCT FROM r_rg AND CASE WHEN n + r_n = 0 THEN true WHEN n = 0 OR r_n = 0 THEN false ELSE (c1 IN (r_c1, r_c2) OR c2 IN (r_c1, r_c2)) AND x[2][1] - x[1][2] <= {gap} AND x[3][1] - x[2][2] <= {gap} AND x[4][1] - x[3][2] <= {gap} END AS owners,
n = 0 OR r_n = 0 OR c1 IN (r_c1, r_c2) OR c2 IN (r_c1, r_c2) AS loose, NOT (sa OR r_sb OR hard OR r_hard) AS warn FROM q)"""


@query("WITH {S}" + OWNED.replace("{gap}", "36000") + " SELECT id, owners, loose, warn FROM k")
def owner_agreement(spark, d):
    a, b = F.col("left"), F.col("right")
    return _owned(spark, d).select(
        "id", ev.owners_agree(a["spans"], b["spans"], a["region"], b["region"], 36_000.0).alias("owners"), ev.owners_agree_loosely(a["spans"], b["spans"]).alias("loose"),
        ev.warnings_agree(a["warnings"], b["warnings"], a["split_after"], b["split_before"]).alias("warn"),
    )


@query("WITH {S}" + OWNED.replace("{gap}", "360000") + """ SELECT id, r_id AS next_id FROM k WHERE sp IS NOT DISTINCT FROM r_sp AND warn AND owners AND r_t0 - t1 <= 360000 AND greatest(t1, r_t1) - least(t0, r_t0) <= 1000000""")
def mergeable_neighbours(spark, d):
    return _owned(spark, d).where(ev.may_merge(F.col("left"), F.col("right"), 360_000.0, 1_000_000.0)).select("id", F.col("right.id").alias("next_id"))


@query(f"""WITH {{S}}, g AS (SELECT id, t0 + 90 AS t0, t1 + 90 AS t1, (t0 + t1) / 2 + 90 AS mid FROM s) SELECT id, {MS.format("t0")}, {MS.format("t1")}, {MS.format("mid")} FROM g""")
def shift_events(spark, d):
    mid = (F.col("t0") + F.col("t1")) / 2
    held = F.array(F.struct(F.col("t0").alias("start"), mid.alias("end"), F.lit("a").alias("clip")), F.struct(mid.alias("start"), F.col("t1").alias("end"), F.lit("b").alias("clip")))
    s = spans(spark, d).select("id", ev.shifted(held, F.lit(90.0)).alias("x"))
    return s.select("id", F.col("x")[0]["start"].alias("t0"), F.col("x")[1]["end"].alias("t1"), F.col("x")[1]["start"].alias("mid")).select("id", *_ms("t0", "t1", "mid"))


@query("""WITH {S}, n AS (SELECT *, (row_number() OVER (PARTITION BY media_id ORDER BY t0, t1, id) - 1) // 3 AS grp FROM s),
e AS (SELECT media_id, grp, id, t0, t1, id % 17 = 0 AND row_number() OVER w > 1 AS split, CASE WHEN id % 3 > 0 THEN id % 2 END AS bin, CASE WHEN id % 2 = 0 THEN speaker END AS who, id % 19 = 0 AS tracks, lead(t0) OVER w - t1 > 200000 AS gap
FROM n WINDOW w AS (PARTITION BY media_id, grp ORDER BY t0, t1)),
f AS (SELECT media_id, grp, count(*) AS n, bool_or(split) AS split, min(bin) < max(bin) AS bins, min(who) < max(who) AS who, bool_or(tracks) AS tracks, bool_or(gap) AS gap, max_by(t1, (t0, t1)) - min(t0) > 300000 AS long FROM e GROUP BY ALL)
SELECT media_id, grp, CASE WHEN n < 2 THEN NULL WHEN split THEN 'split' WHEN bins THEN 'bins' WHEN who THEN 'speakers' WHEN tracks THEN 'tracks' WHEN gap THEN 'gap' WHEN long THEN 'long' END AS fault FROM f""")
def group_merge_faults(spark, d):
    i = F.col("id")
    g = spans(spark, d).withColumn("grp", F.floor((F.row_number().over(_along()) - 1) / 3).cast("long"))
    events = g.select("media_id", "grp", F.col("t0").alias("start"), F.col("t1").alias("end"), (i % 17 == 0).alias("split_before"), F.when(i % 3 > 0, i % 2).alias("bin"), "speaker", (i % 2 == 0).alias("confirmed"), (i % 19 == 0).alias("overlap"))
    return op.merge_fault(events, ["media_id", "grp"], 200_000.0, 300_000.0)


@query("""WITH {S}, n AS (SELECT *, CASE WHEN id % 5 = 0 THEN NULL ELSE speaker END AS who, CASE WHEN id % 3 = 0 THEN NULL ELSE id % 2 END AS region FROM s)
SELECT id, coalesce(lead(id) OVER w IS NOT NULL AND coalesce(who = lead(who) OVER w, true) AND coalesce(region = lead(region) OVER w, true) AND NOT coalesce(id % 7 = 0 OR lead(id % 11 = 0) OVER w, false), false) AS mergeable
FROM n WINDOW w AS (PARTITION BY media_id ORDER BY t0, id)""")
def forward_mergeable(spark, d):
    i = F.col("id")
    g = spans(spark, d).select("media_id", "id", F.col("t0").alias("start"), F.when(i % 5 == 0, None).otherwise(F.col("speaker")).alias("speaker"), F.when(i % 3 == 0, None).otherwise(i % 2).alias("region"), (i % 11 == 0).alias("split_before"), (i % 7 == 0).alias("split_after"))
    return op.next_mergeable(g, M).select("id", "mergeable")


@query(r"""WITH c AS (SELECT conv_id, turn, trim(CASE turn % 4 WHEN 0 THEN text WHEN 1 THEN '2. ' || text WHEN 2 THEN text || ' with courtesy.' ELSE 'Answer ' || text END) AS t FROM conversations),
n AS (SELECT *, lead(t) OVER (PARTITION BY conv_id ORDER BY turn) AS f FROM c)
SELECT conv_id, turn, regexp_matches(f, '^\d+[.)]\s') OR regexp_matches(f, '^(One|Two|Three|Four|Five|Six|Seven|Eight|Nine|Ten)[,.\s]') OR regexp_matches(f, '^[一二三四五六七八九十][、，.]')
 OR regexp_matches(f, '(?i)^(Summary\s+(and|&)\s+review|Example[:]?|Effective\s+Communication|Phone\s+Etiquette|Rapid\s+Response|Answer|Listen|Hang\s+up|Identify|End\s+with\s+courtesy)') OR regexp_matches(t, '(?i)(^|\s)(and|with)\s+courtesy[.]?\s*$') AS breaks
FROM n WHERE f IS NOT NULL""")
def section_breaks(spark, d):
    k, t = F.col("turn") % 4, F.col("text")
    said = F.when(k == 0, t).when(k == 1, F.concat(F.lit("2. "), t)).when(k == 2, F.concat(t, F.lit(" with courtesy."))).otherwise(F.concat(F.lit("Answer "), t))
    c = table(spark, d, "conversations").select("conv_id", "turn", said.alias("t"))
    return c.withColumn("f", F.lead("t").over(W.partitionBy("conv_id").orderBy("turn"))).where("f is not null").select("conv_id", "turn", ev.section_break(F.col("t"), F.col("f")).alias("breaks"))


@query(r"""WITH c AS (SELECT conv_id, turn, rtrim(CASE turn % 3 WHEN 0 THEN text ELSE regexp_replace(text, '[.!?]*$', '') || ' because.' END) AS t FROM conversations)
SELECT conv_id, turn, coalesce(length(t) >= 2 AND regexp_matches(t, '[.!?。！？]$') AND len(regexp_split_to_array(trim(t), '\s+')) >= 5 AND regexp_replace(lower(regexp_extract(t, '(\S+)$', 1)), '[.!?。！？,，;；:：]+$', '') IN
 ({LOOSE}), false) AS doubtful FROM c""".replace("{LOOSE}", ", ".join(f"'{w}'" for w in ev.LOOSE_ENDS)))
def doubtful_stops(spark, d):
    t = F.when(F.col("turn") % 3 == 0, F.col("text")).otherwise(F.concat(F.regexp_replace("text", "[.!?]*$", ""), F.lit(" because.")))
    return table(spark, d, "conversations").select("conv_id", "turn", ev.doubtful_stop(t).alias("doubtful"))


@query(r"""WITH w AS (SELECT conv_id, turn, string_split(text, ' ') AS w FROM conversations), x AS (SELECT conv_id, turn, len(w) AS n, w FROM w)
SELECT conv_id, turn, len(list_filter(range(0, n), lambda i: trim(w[i + 1]) <> '' AND i % 3 > 0 AND (i * 7 % 10) / 20.0 >= 0.35)) > 0 AS evidence,
 CASE WHEN ((n - 1) * 7 % 10) / 20.0 >= 0.35 THEN true ELSE false END AS keeps_end FROM x""")
def word_evidence(spark, d):
    words = F.transform(F.split("text", " "), lambda w, i: F.struct(w.alias("text"), i.cast("double").alias("start"), (i + i % 3).cast("double").alias("end"), ((i * 7 % 10) / F.lit(20.0)).alias("confidence")))
    c = table(spark, d, "conversations").select("conv_id", "turn", words.alias("w"))
    return c.select("conv_id", "turn", ev.has_word_evidence(F.col("w")).alias("evidence"), ev.keeps_edge(F.col("w"), True, 0.35).alias("keeps_end"))


@query("""WITH {S}, o AS (SELECT id, t0 - min(t0) OVER w - 7200 AS a, t1 - min(t0) OVER w - 7200 - CASE WHEN id % 9 = 0 THEN 100000 ELSE 0 END AS b, (max(t1) OVER w - min(t0) OVER w) * 0.75 AS d FROM s WINDOW w AS (PARTITION BY media_id))
SELECT id, CASE WHEN a < 0 OR b <= a THEN 'range' WHEN a + 60 < 0 OR b + 60 > d THEN 'timeline' END AS fault, b > 3600.01 AND a < 86399.99 AS near FROM o""")
def evidence_faults(spark, d):
    w = W.partitionBy("media_id")
    o = F.min("t0").over(w)
    s = spans(spark, d).select("id", (F.col("t0") - o - 7200).alias("a"), (F.col("t1") - o - 7200 - F.when(F.col("id") % 9 == 0, 100_000).otherwise(0)).alias("b"), ((F.max("t1").over(w) - o) * 0.75).alias("d"))
    return s.select("id", ev.evidence_fault(F.col("a"), F.col("b"), F.lit(60.0), F.col("d")).alias("fault"), ev.overlaps_request(F.col("a"), F.col("b"), F.lit(3600.0), F.lit(86_400.0)).alias("near"))


@query("""SELECT event_id, CASE WHEN c IS NULL THEN 'unknown' WHEN c >= 0.9 THEN 'high' WHEN c >= 0.6 THEN 'medium' ELSE 'low' END AS tier, CAST(CASE WHEN c >= 0.9 THEN 0.2 WHEN c >= 0.6 THEN 0.3 ELSE 0.5 END AS DOUBLE) AS span,
 CAST(CASE WHEN event_id % 12 > 5 THEN 1.0 WHEN event_id % 3 = 0 THEN 2.0 WHEN abs(1.0 - v) <= abs(2.0 - v) THEN 1.0 ELSE 2.0 END AS DOUBLE) AS edge, CASE WHEN event_id % 10 = 0 OR event_id % 4 = 0 THEN 500 WHEN (event_id % 10) / CAST(event_id % 4 AS DOUBLE) > 5 THEN 1000
 WHEN (event_id % 10) / CAST(event_id % 4 AS DOUBLE) > 4 THEN 750 ELSE 500 END AS overlap_ms FROM (SELECT event_id, CASE WHEN event_id % 8 = 0 THEN NULL ELSE (event_id % 100) / 100.0 END AS c, CAST(event_id % 5 AS DOUBLE) AS v FROM events)""")
def boundary_choices(spark, d):
    i = F.col("event_id")
    t = ev.tier(F.when(i % 8 == 0, None).otherwise((i % 100) / 100.0))
    edge = ev.chosen_edge(F.lit(1.0), (i % 12).cast("double"), F.lit(2.0), i % 3 == 0, (i % 5).cast("double"))
    rate = ev.speech_overlap_ms(i % 10, F.when(i % 4 == 0, F.lit(0.0)).otherwise((i % 4).cast("double")))
    return table(spark, d, "events").select("event_id", t.alias("tier"), ev.tier_window(t).alias("span"), edge.alias("edge"), rate.alias("overlap_ms"))


@query(f"""WITH {{S}}, g AS (SELECT id, media_id, CASE WHEN id % 6 = 0 THEN NULL ELSE speaker END AS who, t0 AS a, t1 AS b, id % 2 = 0 AS deg, (max(t1) OVER (PARTITION BY media_id)) - 600 AS d FROM s),
t AS (SELECT *, CASE WHEN deg THEN greatest(a, a + (b - a) / 4 - 0.15) ELSE a END AS x, CASE WHEN deg THEN least(b, a + (b - a) / 2 + 0.15) ELSE b END AS y FROM g),
u AS (SELECT *, CASE WHEN y - x < 1800 THEN least(x + 1800, d) ELSE y END AS z FROM t), v AS (SELECT id, media_id, who, a, greatest(0, x) AS shown, CASE WHEN least(d, z) <= greatest(0, x) THEN greatest(0, x) + 1800 ELSE least(d, z) END AS gone FROM u),
c AS (SELECT *, coalesce(lag(who) OVER w <> who AND shown < lag(gone) OVER w, false) AS conflict FROM v WINDOW w AS (PARTITION BY media_id ORDER BY a, id)),
f AS (SELECT id, conflict, greatest(0, CASE WHEN conflict THEN least(shown, a) ELSE shown END) AS shown, gone FROM c) SELECT id, conflict, {MS.format("shown")}, {MS.format("gone")} FROM f""")
def display_windows(spark, d):
    i = F.col("id")
    length = F.col("end") - F.col("start")
    g = spans(spark, d).select("media_id", "id", F.when(i % 6 == 0, None).otherwise(F.col("speaker")).alias("speaker"), F.col("t0").alias("start"), F.col("t1").alias("end"), (i % 2 == 0).alias("degraded"), (F.max("t1").over(W.partitionBy("media_id")) - 600).alias("d"))
    g = g.withColumn("from", F.col("start") + length / 4).withColumn("to", F.col("start") + length / 2)
    return op.display_times(g, M, F.col("d"), reading=1800.0).select("id", "conflict", F.col("show").alias("shown"), F.col("hide").alias("gone")).select("id", "conflict", *_ms("shown", "gone"))


@query(f"""WITH {{S}}, n AS (SELECT *, (row_number() OVER (PARTITION BY media_id ORDER BY t0, t1, id) - 1) // 4 AS region, row_number() OVER (PARTITION BY media_id ORDER BY t0, t1, id) AS n FROM s),
r AS (SELECT *, min(t0) OVER w AS o, max(t1) OVER w - 1200 AS z FROM n WINDOW w AS (PARTITION BY media_id, region)),
e AS (SELECT id, o + CASE WHEN id % 3 = 0 THEN t0 - o + 30 ELSE t0 - o END AS a, CASE WHEN row_number() OVER (PARTITION BY media_id, region ORDER BY n DESC) = 1 THEN z ELSE o + CASE WHEN id % 3 = 0 THEN t1 - o - 30 ELSE t1 - o END END AS b, z FROM r),
f AS (SELECT id, a AS t0, least(b, greatest(z, b - 0.05) + 0.15) AS t1 FROM e) SELECT id, {MS.format("t0")}, {MS.format("t1")} FROM f WHERE t1 > t0""")
def segments_to_timeline(spark, d):
    s = spans(spark, d).withColumn("n", F.row_number().over(_along())).withColumn("region", F.floor((F.col("n") - 1) / 4))
    w = W.partitionBy("media_id", "region")
    s = s.withColumn("offset", F.min("t0").over(w)).withColumn("stop", F.max("t1").over(w) - 1200)
    own = F.col("id") % 3 == 0
    s = s.select("media_id", "region", "id", "n", "offset", "stop", (F.col("t0") - F.col("offset")).alias("start"), (F.col("t1") - F.col("offset")).alias("end"))
    s = s.withColumn("first", F.when(own, F.col("start") + 30)).withColumn("last", F.when(own, F.col("end") - 30))
    return op.segments_to_timeline(s, ["media_id", "region"]).select("id", F.col("start").alias("t0"), F.col("end").alias("t1")).select("id", *_ms("t0", "t1"))


@query("""WITH {S} SELECT a.id AS "left", b.id AS "right" FROM s a JOIN s b ON a.media_id = b.media_id AND a.speaker = b.speaker AND a.id < b.id
WHERE least(a.t1, b.t1) - greatest(a.t0, b.t0) >= -0.08 AND least(a.t1, b.t1) - greatest(a.t0, b.t0) >= least(a.t1 - a.t0, b.t1 - b.t0) * 0.5 - 0.08""")
def duplicate_words(spark, d):
    return op.duplicate_pairs(spans(spark, d), ["media_id", "speaker"], 6 * HOUR)


@query(f"""WITH {{S}}, r AS (SELECT *, max(t1) OVER (PARTITION BY media_id, speaker ORDER BY t0, t1, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s),
i AS (SELECT *, sum(CASE WHEN reach IS NULL OR t0 - reach > 0.005 THEN 1 ELSE 0 END) OVER (PARTITION BY media_id, speaker ORDER BY t0, t1, id ROWS UNBOUNDED PRECEDING) AS island FROM r),
g AS (SELECT media_id, speaker, min(t0) AS t0, max(t1) AS t1, count(*) AS members FROM i GROUP BY media_id, speaker, island) SELECT media_id, speaker, members, {MS.format("t0")}, {MS.format("t1")} FROM g""")
def merge_spans_by_clip(spark, d):
    return co.coalesce_reach(spans(spark, d), ["media_id", "speaker"], 0.005).select("media_id", "speaker", "members", *_ms("t0", "t1"))


@query("""WITH n AS (SELECT l_quantity AS q, l_discount AS c, l_tax AS x, lead(l_quantity) OVER w AS tq, lead(l_discount) OVER w AS tc, lead(l_tax) OVER w AS tx FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax)),
u AS (SELECT 'quantity' AS dim, q AS now, tq * 0.8 AS trial FROM n UNION ALL SELECT 'discount', c, tc FROM n UNION ALL SELECT 'tax', x, tx * 0.5 FROM n), m AS (SELECT dim, avg(now) AS now, avg(trial) AS trial FROM u WHERE now > 0 AND trial > 0 GROUP BY dim)
SELECT dim, round((trial - now) / now, 6) AS change FROM m WHERE (trial - now) / now < -0.1""")
def degraded_measures(spark, d):
    w = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    runs = table(spark, d, "lineitem").select(
        F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        (F.lead("l_quantity").over(w) * 0.8).alias("t_quantity"), F.lead("l_discount").over(w).alias("t_discount"), (F.lead("l_tax").over(w) * 0.5).alias("t_tax"),
    )
    return op.degraded(runs, ["quantity", "discount", "tax"]).select("dim", F.round("change", 6).alias("change"))


@query("""WITH k(param, measure, c) AS (VALUES ('merging.padding', 'avg_duration', 0.8), ('merging.padding', 'end_truncation', -1.2), ('merging.padding', 'total_lines', -0.3), ('subtitle.max_duration', 'avg_duration', 0.9),
('subtitle.max_duration', 'total_lines', -0.4), ('subtitle.max_duration', 'merge_frequency', 0.3)), a AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'merging.padding' WHEN 1 THEN 'subtitle.max_duration' ELSE 'other' END AS param,
CAST(p_partkey % 50 AS DOUBLE) AS value, CAST(p_partkey % 7 AS DOUBLE) AS delta FROM part) SELECT p_partkey, measure, round(CASE WHEN value > 0 THEN delta / value * 100 ELSE 0 END * c, 4) + 0.0 AS change FROM a JOIN k USING (param)""")
def parameter_impact(spark, d):
    k = F.col("p_partkey")
    param = F.when(k % 3 == 0, "merging.padding").when(k % 3 == 1, "subtitle.max_duration").otherwise("other")
    a = table(spark, d, "part").select(k, param.alias("param"), (k % 50).cast("double").alias("value"), (k % 7).cast("double").alias("delta"))
    return op.impact(a).select("p_partkey", "measure", (F.round("change", 4) + 0.0).alias("change"))


@query("""WITH p AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'merging.padding' WHEN 1 THEN 'subtitle.max_lines' ELSE 'other' END AS param, (event_id % 400) - 5 AS age FROM events)
SELECT event_id, round(CASE param WHEN 'subtitle.max_lines' THEN 1.0 WHEN 'merging.padding' THEN pow(0.5, greatest(0, age) / 60.0) ELSE pow(0.5, greatest(0, age) / 90.0) END, 8) AS weight FROM p""")
def effective_weights(spark, d):
    i = F.col("event_id")
    param = F.when(i % 3 == 0, "merging.padding").when(i % 3 == 1, "subtitle.max_lines").otherwise("other")
    return table(spark, d, "events").select("event_id", F.round(ev.effective_weight((i % 400 - 5).cast("double"), param), 8).alias("weight"))


@query("""WITH {S}, r AS (SELECT media_id, sqrt(avg(CASE WHEN id % 2 = 0 THEN value * value END)) AS a, sqrt(avg(CASE WHEN id % 2 = 1 THEN value * value * 9 END)) AS b FROM s GROUP BY media_id)
SELECT media_id, round(a, 6) AS rms, CASE WHEN b / a >= 2.5 THEN round(least(0.4, (b / a - 2.5) / 7.5), 3) ELSE 0 END AS surge, CASE WHEN a > 0 THEN (b - a) / a <= -0.3 ELSE false END AS rolls_back FROM r WHERE a > 0 AND b > 0 AND abs(b / a - 2.5) > 1e-9""")
def volume_surges(spark, d):
    i, v = F.col("id"), F.col("value")
    r = spans(spark, d).groupBy("media_id").agg(F.sqrt(F.avg(F.when(i % 2 == 0, v * v))).alias("a"), F.sqrt(F.avg(F.when(i % 2 == 1, v * v * 9))).alias("b")).where("a > 0 and b > 0 and abs(b / a - 2.5) > 1e-9")
    return r.select("media_id", F.round("a", 6).alias("rms"), ev.surge(F.col("a"), F.col("b")).alias("surge"), ev.rolls_back(F.col("a"), F.col("b")).alias("rolls_back"))


@query("""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings), v AS (SELECT vec_id, list_sum(list_filter(e, lambda x, i: i % 2 = 1)) AS x, list_sum(list_filter(e, lambda x, i: i % 2 = 0)) AS y FROM e), m AS (SELECT avg(x) AS mx, avg(y) AS my, stddev_pop(x) AS sx, stddev_pop(y) AS sy, count(*) AS n, covar_pop(x, y) AS c FROM v),
k AS (SELECT *, n / (n - 1.0) + 1e-6 AS d, c / sx / sy * n / (n - 1.0) AS o FROM m), z AS (SELECT vec_id, (x - mx) / sx AS a, (y - my) / sy AS b, d, o FROM v, k),
q AS (SELECT vec_id, sqrt(greatest(0, (d * a * a - 2 * o * a * b + d * b * b) / (d * d - o * o))) AS dist FROM z) SELECT vec_id, round(dist, 5) AS distance, round(exp(-dist / sqrt(2.0)), 5) AS similarity FROM q""")
def covariance_distances(spark, d):
    """Of the sums over the odd and the even places of each whole vector; a test holds wider vectors against numpy."""
    side = lambda k: F.aggregate(F.filter(F.col("embedding").cast("array<double>"), lambda x, i: i % 2 == k), F.lit(0.0), lambda a, x: a + x)
    v = table(spark, d, "embeddings").select("vec_id", F.array(side(0), side(1)).alias("v"))
    fitted = op.CovarianceDistance.fit(v, "v", 2)
    return fitted.add_distance(v, "v").select("vec_id", F.round("distance", 5).alias("distance"), F.round(ev.covariance_similarity(F.col("distance"), 2), 5).alias("similarity"))


@query("""WITH {S}, r AS (SELECT media_id, count(*) AS n, avg(value) AS mae, avg(CASE WHEN id % 4 > 0 THEN value / 100 END) AS health, sum(value) AS elapsed FROM s GROUP BY media_id),
a AS (SELECT round(avg(CASE WHEN n >= 3 THEN mae END), 6) AS mae, round(avg(CASE WHEN n >= 3 THEN coalesce(health, 0) END), 6) AS health, round(CASE WHEN count_if(n >= 3) > 0 THEN sum(elapsed) ELSE 0 END, 4) AS elapsed, count_if(n >= 3) AS good FROM r)
SELECT *, mae <= 300 AS mae_ok, health >= 0.9 AS health_ok FROM a""")
def benchmark_summary(spark, d):
    s = spans(spark, d).groupBy("media_id").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mae"), F.avg(F.when(F.col("id") % 4 > 0, F.col("value") / 100)).alias("health"), F.sum("value").alias("elapsed"))
    good = F.col("n") >= 3
    a = s.agg(
        F.round(F.avg(F.when(good, F.col("mae"))), 6).alias("mae"), F.round(F.avg(F.when(good, F.coalesce("health", F.lit(0.0)))), 6).alias("health"),
        F.round(F.when(F.count_if(good) > 0, F.sum("elapsed")).otherwise(0.0), 4).alias("elapsed"), F.count_if(good).alias("good"),
    )
    return a.select("*", (F.col("mae") <= 300).alias("mae_ok"), (F.col("health") >= 0.9).alias("health_ok"))


@query("""SELECT conv_id, round(avg(-(turn % 4) * 0.75), 6) AS confidence, avg(-(turn % 4) * 0.75) < -1.2 AS falls_back, bool_and(turn % 5 > 0) AS accepts FROM conversations GROUP BY conv_id""")
def language_fallback(spark, d):
    lp = -(F.col("turn") % 4) * F.lit(0.75)
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.avg(lp).alias("m"), F.bool_and(F.col("turn") % 5 > 0).alias("accepts"))
    return c.select("conv_id", F.round("m", 6).alias("confidence"), (F.col("m") < -1.2).alias("falls_back"), "accepts")


@query(r"""WITH c AS (SELECT conv_id, turn, text, CASE WHEN turn % 2 = 0 THEN role END AS label FROM conversations)
SELECT conv_id, turn, CASE WHEN coalesce(label, '') = '' THEN text ELSE '[' || label || '] ' || text END AS bracket, CASE WHEN coalesce(label, '') = '' THEN text ELSE label || ': ' || text END AS prefix,
regexp_replace('[Speaker A]  ' || text, '^\[Speaker [^\]]+\]\s*', '') AS plain, CASE WHEN len(regexp_extract_all(text, '[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]')) / CAST(greatest(1, length(replace(text, ' ', ''))) AS DOUBLE) > 0.5 THEN 40 ELSE 84 END AS room,
regexp_replace(lower(text), '[\s\p{P}\p{Sm}\p{Sc}\p{Sk}\p{So}]', '', 'g') AS bare FROM c""")
def cue_labels(spark, d):
    t, label = F.col("text"), F.when(F.col("turn") % 2 == 0, F.col("role"))
    return table(spark, d, "conversations").select(
        "conv_id", "turn", ev.labelled(t, label, "bracket").alias("bracket"), ev.labelled(t, label, "prefix").alias("prefix"), ev.unlabelled(F.concat(F.lit("[Speaker A]  "), t)).alias("plain"), ev.room(t).alias("room"), ev.bare(t).alias("bare")
    )


@query("""SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN props ELSE props END AS payload FROM events""")
def fenced_payload(spark, d):
    i, p = F.col("event_id") % 3, F.col("props")
    text = F.when(i == 0, F.concat(F.lit("so:\n```json\n"), p, F.lit("\n```\nend"))).when(i == 1, F.concat(F.lit("```"), p, F.lit("```"))).otherwise(F.concat(F.lit("it is "), p, F.lit(" .")))
    return table(spark, d, "events").select("event_id", ev.fenced_json(text).alias("payload"))


@query("""SELECT event_id, value FROM (SELECT event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE value IS NOT NULL) WHERE n <= 20""")
def health_trend(spark, d):
    n = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").where("value is not null").withColumn("n", n).where("n <= 20").select("event_id", "value")
