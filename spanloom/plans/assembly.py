"""Queries from timed words to events, on the words of conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assembly as op
from ..operators import cues as cu
from ..sources.tables import table
from .registry import M, _ms, query

TURN = 100_000
WIDTH = 8.0

#: Words with times, and the clips, evidence, bins, segments and turns of each turn of a conversation; the functions below say the same.
WORDS = """x AS (SELECT conv_id AS media_id, turn, unnest(string_split(text, ' ')) AS text, unnest(range(len(string_split(text, ' ')))) AS k FROM conversations),
y AS (SELECT *, turn * 100000 + k * 400 + ((k * 7 + turn) % 5) * 60 + (k // 9) * 700 AS b FROM x),
w AS (SELECT media_id, 'w' || turn || '-' || k AS id, turn, k, text, b / 1000 AS t0, (b + 150 + (length(text) % 7) * 30 + CASE WHEN k % 13 = 0 THEN 300 ELSE 0 END) / 1000 AS t1, CASE WHEN k % 17 = 5 THEN k % 3 END AS own FROM y),
d AS (SELECT DISTINCT conv_id AS media_id, turn FROM conversations),
c AS (SELECT media_id, turn, i, 'c' || turn || '-' || i AS id, (turn * 100000 + i * 6000) / 1000 AS t0, (turn * 100000 + i * 6000 + CASE WHEN i % 3 = 2 THEN 4800 ELSE 6000 END) / 1000 AS t1 FROM d, range(12) r(i)),
e AS (SELECT media_id, c.id AS clip, 'e' || turn || '-' || i || '-' || j AS id, (turn * 100000 + i * 6000 + j * 3000) / 1000 AS t0, (turn * 100000 + i * 6000 + j * 3000 + 2600 + j * 300) / 1000 AS t1 FROM c, range(2) s(j) WHERE (i * 2 + j) % 7 <> 3),
b AS (SELECT media_id, 'b' || turn || '-' || n AS id, (turn * 100000 + n * 3500) / 1000 AS t0, (turn * 100000 + n * 3500 + 3000 + CASE WHEN n % 3 = 0 THEN 400 ELSE 0 END) / 1000 AS t1 FROM d, range(20) q(n) WHERE n % 5 <> 4)"""


def _at(turn, ms):
    return (turn * TURN + ms) / 1000


def _words(spark, d) -> DataFrame:
    x = table(spark, d, "conversations").select(F.col("conv_id").alias("media_id"), "turn", F.posexplode(F.split("text", " ")).alias("k", "text"))
    k, b = F.col("k"), F.col("k") * 400 + ((F.col("k") * 7 + F.col("turn")) % 5) * 60 + F.floor(F.col("k") / 9) * 700
    end = b + 150 + (F.length("text") % 7) * 30 + F.when(k % 13 == 0, 300).otherwise(0)
    own = F.when(k % 17 == 5, k % 3)
    return x.select("media_id", F.format_string("w%d-%d", "turn", "k").alias("id"), "turn", "k", "text", _at(F.col("turn"), b).alias("t0"), _at(F.col("turn"), end).alias("t1"), own.alias("speaker"))


def _turns(spark, d) -> DataFrame:
    return table(spark, d, "conversations").select(F.col("conv_id").alias("media_id"), "turn").distinct()


def _each(turns: DataFrame, n: int, name: str) -> DataFrame:
    return turns.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))


def _timeline(spark, d) -> dict[str, DataFrame]:
    turn, i, j, n = F.col("turn"), F.col("i"), F.col("j"), F.col("n")
    c = _each(_turns(spark, d), 12, "i")
    clip = F.format_string("c%d-%d", "turn", "i")
    clips = c.select("media_id", clip.alias("id"), _at(turn, i * 6000).alias("t0"), _at(turn, i * 6000 + F.when(i % 3 == 2, 4800).otherwise(6000)).alias("t1"))
    e = _each(c, 2, "j").where((i * 2 + j) % 7 != 3)
    start = i * 6000 + j * 3000
    evidence = e.select("media_id", clip.alias("clip"), F.format_string("e%d-%d-%d", "turn", "i", "j").alias("id"), _at(turn, start).alias("t0"), _at(turn, start + 2600 + j * 300).alias("t1"))
    b = _each(_turns(spark, d), 20, "n").where(n % 5 != 4)
    bins = b.select("media_id", F.format_string("b%d-%d", "turn", "n").alias("id"), _at(turn, n * 3500).alias("t0"), _at(turn, n * 3500 + 3000 + F.when(n % 3 == 0, 400).otherwise(0)).alias("t1"))
    held = lambda who, a, z: F.struct(F.lit(who).alias("speaker"), _at(turn, F.lit(a)).alias("t0"), _at(turn, F.lit(z)).alias("t1"))
    some = _turns(spark, d)
    exclusive = some.where("turn % 3 = 0").select("media_id", F.inline(F.array(held(0, 0, 20_000), held(1, 20_000, 45_000), held(2, 40_000, 45_000))))
    spoken = some.select("media_id", F.inline(F.array(held(3, 30_000, 60_000), held(4, 58_000, 60_000))))
    return {"clips": clips, "evidence": evidence, "bins": bins, "exclusive": exclusive, "turns": spoken}


def _segments(words: DataFrame) -> DataFrame:
    said = words.groupBy("media_id", "turn").agg(F.collect_list("id").alias("words"))
    return said.select("media_id", F.col("turn").alias("n"), F.when(F.col("turn") % 3 > 0, F.col("turn") % 2).cast("int").alias("speaker"), "words")


def _allocated(spark, d, strict: bool = False) -> DataFrame:
    words, line = _words(spark, d), _timeline(spark, d)
    return op.allocate_words(words, line["clips"], line["evidence"], M, WIDTH, bins=line["bins"], segments=_segments(words), exclusive=line["exclusive"], turns=line["turns"], strict=strict)


ALLOCATED = """sp AS (SELECT w.media_id, w.id, c.id AS clip, greatest(w.t0, c.t0) AS s0, least(w.t1, c.t1) AS s1 FROM w JOIN c ON w.media_id = c.media_id AND w.t0 < c.t1 AND c.t0 < w.t1 WHERE least(w.t1, c.t1) > greatest(w.t0, c.t0)),
pe AS (SELECT sp.*, e.id AS eid, e.t0 AS e0, e.t1 AS e1 FROM sp LEFT JOIN e ON sp.media_id = e.media_id AND sp.clip = e.clip AND e.t0 < s1 AND e.t1 > s0),
ps AS (SELECT media_id, id, clip, s0, s1, list(eid ORDER BY e0, e1, eid) FILTER (eid IS NOT NULL) AS ev, list({'start': e0, 'end': e1, 'id': eid, 'clip': clip} ORDER BY e0, e1, eid) FILTER (eid IS NOT NULL) AS es FROM pe GROUP BY ALL),
pw AS (SELECT media_id, id, count(*) AS n, list({'start': s0, 'end': s1, 'clip': clip, 'evidence': coalesce(ev, [])} ORDER BY s0, s1, clip) AS spans, coalesce(list_sort(flatten(list(es) FILTER (es IS NOT NULL))), []) AS evidence FROM ps GROUP BY ALL),
hb AS (SELECT DISTINCT w.media_id, w.id FROM w JOIN b ON w.media_id = b.media_id AND w.t0 < b.t1 + 0.005::DOUBLE AND b.t0 - 0.005::DOUBLE < w.t1),
tn AS (SELECT media_id, 0 AS layer, unnest([0, 1, 2]) AS speaker, (turn * 100000 + unnest([0, 20000, 40000])) / 1000 AS t0, (turn * 100000 + unnest([20000, 45000, 45000])) / 1000 AS t1 FROM d WHERE turn % 3 = 0
UNION ALL SELECT media_id, 1, unnest([3, 4]), (turn * 100000 + unnest([30000, 58000])) / 1000, (turn * 100000 + 60000) / 1000 FROM d),
hs AS (SELECT w.media_id, w.id, list(DISTINCT speaker) FILTER (layer = 0) AS h0, list(DISTINCT speaker) FILTER (layer = 1) AS h1 FROM w JOIN tn ON w.media_id = tn.media_id AND (w.t0 + w.t1) / 2 >= tn.t0 AND (w.t0 + w.t1) / 2 < tn.t1 GROUP BY ALL),
al AS (SELECT w.*, coalesce(spans, []) AS spans, coalesce(evidence, []) AS evidence, coalesce(n, 0) AS n, hb.id IS NOT NULL AS inside, CASE WHEN turn % 3 > 0 THEN turn % 2 END AS seg, coalesce(len(h0), 0) AS n0, coalesce(len(h1), 0) AS n1, h0, h1
FROM w LEFT JOIN pw USING (media_id, id) LEFT JOIN hb USING (media_id, id) LEFT JOIN hs USING (media_id, id)),
an AS (SELECT *, CASE WHEN n = 0 THEN ['outside_physical_clip'] WHEN NOT inside THEN ['outside_speech_bin'] {strict} END AS refused,
CASE WHEN own IS NOT NULL THEN 'word' WHEN seg IS NOT NULL THEN 'segment' WHEN n0 = 1 THEN 'exclusive_turn' WHEN n0 > 1 THEN 'mixed' WHEN n1 = 1 THEN 'turn' WHEN n1 > 1 THEN 'mixed' ELSE 'unknown' END AS said FROM al),
a AS (SELECT media_id, id, turn, k, text, t0, t1, spans, evidence, refused IS NULL AS accepted, coalesce(refused, list_filter([CASE WHEN n > 1 THEN 'cross_physical_boundary' END, CASE WHEN len(evidence) = 0 THEN 'missing_speech_evidence' END, CASE WHEN said = 'mixed' THEN 'speaker_conflict' END], lambda x: x IS NOT NULL)) AS warnings,
CASE WHEN refused IS NULL THEN said ELSE 'unknown' END AS speaker_source, CASE WHEN refused IS NULL THEN coalesce(own, seg, CASE WHEN n0 = 1 THEN h0[1] WHEN n0 = 0 AND n1 = 1 THEN h1[1] END) END AS speaker FROM an)"""
LOOSE = f"WITH {WORDS}, {ALLOCATED.replace('{strict}', '')}"
STRICT = "WHEN n > 1 AND len(list_filter(range(1, n), lambda i: spans[i + 1]['start'] - spans[i]['end'] > 0.005::DOUBLE)) > 0 THEN ['cross_physical_boundary', 'discontinuous_physical_boundary']"
SPANS_SQL = "array_to_string(list_transform({0}, lambda s: s.clip || '@' || CAST(round(s.start * 1000) AS BIGINT) || '-' || CAST(round(s.end * 1000) AS BIGINT) || '[' || array_to_string(s.evidence, ' ') || ']'), ';')"


def _shown(spans):
    ms = lambda x: F.round(x * 1000).cast("long").cast("string")
    return F.array_join(F.transform(spans, lambda s: F.concat(s["clip"], F.lit("@"), ms(s["start"]), F.lit("-"), ms(s["end"]), F.lit("["), F.array_join(s["evidence"], " "), F.lit("]"))), ";")


@query(LOOSE + f" SELECT media_id, id, accepted, speaker, speaker_source, array_to_string(warnings, ';') AS warnings, len(evidence) AS n_evidence, {SPANS_SQL.format('spans')} AS spans FROM a")
def allocate_words(spark, d):
    a = _allocated(spark, d)
    return a.select("media_id", "id", "accepted", "speaker", "speaker_source", F.array_join("warnings", ";").alias("warnings"), F.size("evidence").alias("n_evidence"), _shown("spans").alias("spans"))


@query(f"WITH {WORDS}, {ALLOCATED.replace('{strict}', STRICT)}" + """ SELECT media_id, count(*) AS words, count_if(accepted) AS accepted, count_if(NOT accepted) AS rejected, count_if(list_contains(warnings, 'cross_physical_boundary')) AS crossing,
count_if(list_contains(warnings, 'missing_speech_evidence')) AS without_evidence, count_if(list_contains(warnings, 'outside_speech_bin')) AS outside_bins, count_if(accepted AND speaker_source NOT IN ('word', 'unknown')) AS borrowed_speaker FROM a GROUP BY media_id""")
def allocation_counts(spark, d):
    return op.allocation_counts(_allocated(spark, d, strict=True), M)


@query(f"""WITH {WORDS}, tn AS (SELECT media_id, unnest([0, 1, 2]) AS speaker, (turn * 100000 + unnest([0, 20000, 40000])) / 1000 AS t0, (turn * 100000 + unnest([20000, 45000, 45000])) / 1000 AS t1 FROM d WHERE turn % 3 = 0
UNION ALL SELECT media_id, unnest([3, 4]), (turn * 100000 + unnest([30000, 58000])) / 1000, (turn * 100000 + 60000) / 1000 FROM d)
SELECT w.media_id, w.id, max_by(speaker, (tn.t1 - tn.t0, -tn.t0, speaker)) AS speaker FROM w JOIN tn ON w.media_id = tn.media_id AND tn.t0 <= w.t0 AND w.t0 < tn.t1 GROUP BY ALL""")
def longest_turn_at(spark, d):
    line = _timeline(spark, d)
    return op.turn_at(_words(spark, d).select("media_id", "id", F.col("t0").alias("t")), line["exclusive"].unionByName(line["turns"]), M, WIDTH)


#: Groups of accepted words: f says whether a word follows the one before it, r numbers the runs and g the groups.
FOLLOWS = """l AS (SELECT *, lag(t1) OVER o AS p1, lag(speaker) OVER o AS ps, lag(speaker_source) OVER o AS pq, lag(spans) OVER o AS pp, lag(evidence) OVER o AS pv, row_number() OVER o AS rn FROM a WHERE accepted WINDOW o AS (PARTITION BY media_id ORDER BY t0, t1, id)),
l2 AS (SELECT *, list_sort(list_transform(list_concat(pp, spans), lambda s: [s.start, s.end])) AS u FROM l),
f AS (SELECT * EXCLUDE (u), coalesce(speaker IS NOT DISTINCT FROM ps AND speaker_source <> 'mixed' AND pq <> 'mixed' AND t0 - p1 >= -0.01::DOUBLE AND t0 - p1 <= 0.8::DOUBLE
AND (len(evidence) = 0 OR len(pv) = 0 OR list_min(list_transform(evidence, lambda e: e.start)) - list_max(list_transform(pv, lambda e: e.end)) <= 0.35::DOUBLE)
AND list_min(list_transform(spans, lambda s: s.start)) - list_max(list_transform(pp, lambda s: s.end)) <= 0.8::DOUBLE
AND (list_has_any(list_transform(pp, lambda s: s.clip), list_transform(spans, lambda s: s.clip)) OR len(list_filter(range(1, len(u)), lambda i: u[i + 1][1] - u[i][2] > 0.01::DOUBLE)) = 0), false) AS follows FROM l2)"""
EVENT_COLUMNS = """media_id, CAST(row_number() OVER (PARTITION BY media_id ORDER BY g) AS INTEGER) AS event, CAST(round(t0 * 1000) AS BIGINT) AS t0_ms, CAST(round(t1 * 1000) AS BIGINT) AS t1_ms, n_words, speaker,
CASE WHEN speaker IS NOT NULL THEN 'known' WHEN mixed THEN 'mixed' ELSE 'unknown' END AS speaker_status"""
GROUPED = """arg_min(t0, rn) AS t0, arg_max(t1, rn) AS t1, count(*) AS n_words, first(speaker ORDER BY rn) AS speaker, bool_or(speaker_source = 'mixed') AS mixed,
list_distinct(flatten(list(warnings))) AS ws, flatten(list(list_filter(list_transform(evidence, lambda e: {'start': greatest(t0, e.start), 'end': least(t1, e.end), 'clip': e.clip, 'evidence': [e.id]}), lambda s: s.start < s.end) ORDER BY rn)) AS ev, flatten(list(spans ORDER BY rn)) AS pl"""


@query(LOOSE + f""", {FOLLOWS}, g AS (SELECT *, sum(CAST(NOT follows AS INTEGER)) OVER (PARTITION BY media_id ORDER BY rn) AS g FROM f), h AS (SELECT media_id, g, {GROUPED} FROM g GROUP BY media_id, g),
z AS (SELECT {EVENT_COLUMNS}, CASE WHEN len(ev) > 0 THEN ev ELSE pl END AS spans, len(ws) + 1 AS n_warnings FROM h),
s AS (SELECT media_id, event, unnest(spans) AS s FROM z), s2 AS (SELECT media_id, event, s.clip AS clip, s.evidence AS evidence, s.start AS a, s.end AS b FROM s),
s3 AS (SELECT *, max(b) OVER (PARTITION BY media_id, event, clip, evidence ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM s2),
s4 AS (SELECT *, sum(CASE WHEN a <= r + 0.005::DOUBLE THEN 0 ELSE 1 END) OVER (PARTITION BY media_id, event, clip, evidence ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS q FROM s3),
s5 AS (SELECT media_id, event, clip, evidence, min(a) AS start, max(b) AS "end" FROM s4 GROUP BY media_id, event, clip, evidence, q),
s6 AS (SELECT media_id, event, list({{'start': start, 'end': "end", 'clip': clip, 'evidence': evidence}} ORDER BY start, "end", clip, evidence) AS spans FROM s5 GROUP BY ALL)
SELECT z.* EXCLUDE (spans), {SPANS_SQL.format('s6.spans')} AS spans FROM z JOIN s6 USING (media_id, event)""")
def build_events(spark, d):
    e = op.build_events(_allocated(spark, d), M)
    return e.select("media_id", "event", *_ms("t0", "t1"), F.size("words").alias("n_words"), "speaker", "speaker_status", F.size("warnings").alias("n_warnings"), _shown("spans").alias("spans"))


#: Groups of words that end at bins too, with the bounds of the bins that have one group.
BINNED = """ov AS (SELECT w.media_id, w.id, max_by({'id': b.id, 'start': b.t0, 'end': b.t1}, (least(w.t1, b.t1) - greatest(w.t0, b.t0), -abs((w.t0 + w.t1) / 2 - (b.t0 + b.t1) / 2), b.id)) AS bin
FROM w JOIN b ON w.media_id = b.media_id AND w.t0 < b.t1 AND b.t0 < w.t1 AND least(w.t1, b.t1) > greatest(w.t0, b.t0) GROUP BY ALL),
r AS (SELECT f.*, ov.bin, sum(CAST(NOT follows AS INTEGER)) OVER (PARTITION BY f.media_id ORDER BY rn) AS run FROM f LEFT JOIN ov USING (media_id, id)),
r2 AS (SELECT *, first_value(bin.id) OVER q AS began, last_value(bin.id IGNORE NULLS) OVER (PARTITION BY media_id, run ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM r WINDOW q AS (PARTITION BY media_id, run ORDER BY rn)),
g AS (SELECT *, sum(CASE WHEN NOT follows OR coalesce(bin.id <> seen AND began IS NOT NULL, false) THEN 1 ELSE 0 END) OVER (PARTITION BY media_id ORDER BY rn) AS g FROM r2),
h AS (SELECT media_id, g, {grouped}, first(bin ORDER BY rn) AS bin, list(text ORDER BY rn) AS texts FROM g GROUP BY media_id, g),
z AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY media_id, bin.id) = 1 THEN bin END AS own FROM h)""".replace("{grouped}", GROUPED)


@query(LOOSE + f", {FOLLOWS}, {BINNED} SELECT {EVENT_COLUMNS}, own.id AS bin, CAST(round(own.start * 1000) AS BIGINT) AS bin0_ms, CAST(round(own.end * 1000) AS BIGINT) AS bin1_ms FROM z")
def build_bin_events(spark, d):
    e = op.build_events(_allocated(spark, d), M, bins=_timeline(spark, d)["bins"], width=WIDTH)
    return e.select("media_id", "event", *_ms("t0", "t1"), F.size("words").alias("n_words"), "speaker", "speaker_status", "bin", *_ms("bin0", "bin1"))


@query(LOOSE.replace("WITH ", "WITH RECURSIVE ", 1) + f""", {FOLLOWS}, fine AS (SELECT media_id, 'b' || turn || '-' || (k // 2) AS id, min(t0) AS t0, max(t1) AS t1 FROM w GROUP BY media_id, turn, k // 2), {BINNED.replace("JOIN b ON", "JOIN fine b ON")},
m AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY g) AS n, CASE WHEN len(ev) > 0 THEN ev ELSE pl END AS sp, len(replace(array_to_string(list_transform(texts, lambda x: trim(x)), ''), ' ', '')) AS chars, texts[-1] AS tail FROM z),
m2 AS (SELECT *, CASE WHEN len(list_distinct(list_transform(sp, lambda s: s.clip))) = 1 THEN sp[1].clip END AS clip, list_contains(ws, 'speaker_conflict') AS hard FROM m),
j AS (SELECT media_id, n, t0, t1, n_words, speaker, chars, own.id AS bin, coalesce(clip = lag(clip) OVER o AND speaker IS NOT DISTINCT FROM lag(speaker) OVER o AND NOT hard AND NOT lag(hard) OVER o AND NOT regexp_matches(trim(lag(tail) OVER o), '[.!?。！？]$')
AND own.start - lag(own.end) OVER o BETWEEN 0 AND 4 AND t0 - lag(t1) OVER o BETWEEN -0.01::DOUBLE AND 1.2::DOUBLE, false) AS joins FROM m2 WINDOW o AS (PARTITION BY media_id ORDER BY n)),
t AS (SELECT media_id, n, chars AS held, 1 AS first FROM j WHERE n = 1 UNION ALL
SELECT j.media_id, j.n, CASE WHEN joins AND least(held, j.chars) <= 12 THEN held + j.chars ELSE j.chars END, CASE WHEN joins AND least(held, j.chars) <= 12 THEN 0 ELSE 1 END FROM t JOIN j ON t.media_id = j.media_id AND j.n = t.n + 1),
u AS (SELECT j.*, sum(first) OVER (PARTITION BY t.media_id ORDER BY t.n) AS event FROM t JOIN j USING (media_id, n))
SELECT media_id, CAST(event AS INTEGER) AS event, CAST(round(min(t0) * 1000) AS BIGINT) AS t0_ms, CAST(round(arg_max(t1, n) * 1000) AS BIGINT) AS t1_ms, CAST(sum(n_words) AS BIGINT) AS n_words, string_agg(bin, '+' ORDER BY n) AS bin FROM u GROUP BY media_id, event""")
def merge_micro_events(spark, d):
    half = F.floor(F.col("k") / 2).cast("int")
    fine = _words(spark, d).groupBy("media_id", F.format_string("b%d-%d", "turn", half).alias("id")).agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"))
    e = op.build_events(_allocated(spark, d), M, bins=fine, width=WIDTH)
    e = op.merge_micro_events(e, M, max_bin_gap=4.0, max_word_gap=1.2, max_chars=12)
    return e.select("media_id", "event", *_ms("t0", "t1"), F.size("words").cast("long").alias("n_words"), "bin")


@query(f"""WITH RECURSIVE {WORDS}, v AS (SELECT media_id, id, t0, t1, 'c' || turn || '-' || (k // 20) AS clip, CASE WHEN k % 5 < 4 THEN (k // 11) % 3 END AS speaker, k % 4 < 3 AS confirmed, k % 41 = 40 AS overlap, row_number() OVER (PARTITION BY media_id ORDER BY t0, t1, id) AS rn FROM w),
l AS (SELECT *, t0 - lag(t1) OVER o AS gap, lag(clip) OVER o AS pc, last_value(CASE WHEN confirmed THEN speaker END IGNORE NULLS) OVER (PARTITION BY media_id ORDER BY rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS heard FROM v WINDOW o AS (PARTITION BY media_id ORDER BY rn)),
q AS (SELECT *, CASE WHEN overlap THEN 'OverlapRegion' WHEN gap >= 0.6::DOUBLE THEN 'LongPause' WHEN confirmed AND speaker <> heard THEN 'Speaker' WHEN clip <> pc THEN 'PhysicalClip' END AS hard, coalesce(gap >= 0.35::DOUBLE, false) AS soft FROM l),
n AS (SELECT *, lead(hard) OVER o AS nh, hard IS NOT NULL OR coalesce(lag(soft) OVER o, false) AS fresh FROM q WINDOW o AS (PARTITION BY media_id ORDER BY rn)),
r AS (SELECT media_id, rn, t0 AS f0, 1 AS len, 1 AS first FROM n WHERE rn = 1 UNION ALL
SELECT n.media_id, n.rn, CASE WHEN n.fresh OR len >= 15 OR p.t1 - f0 >= 8 THEN n.t0 ELSE f0 END, CASE WHEN n.fresh OR len >= 15 OR p.t1 - f0 >= 8 THEN 1 ELSE len + 1 END, CASE WHEN n.fresh OR len >= 15 OR p.t1 - f0 >= 8 THEN 1 ELSE 0 END
FROM r JOIN n ON n.media_id = r.media_id AND n.rn = r.rn + 1 JOIN n p ON p.media_id = r.media_id AND p.rn = r.rn),
g AS (SELECT n.*, len, f0, sum(first) OVER (PARTITION BY r.media_id ORDER BY r.rn) AS fragment FROM r JOIN n USING (media_id, rn)),
h AS (SELECT media_id, fragment, count(*) AS n_words, arg_min(id, rn) AS first_id, min(t0) AS t0, arg_max(t1, rn) AS t1, arg_min(speaker, rn) FILTER (speaker IS NOT NULL) AS speaker, arg_max(soft, rn) AS soft, arg_max({{'x': nh}}, rn).x AS nh, arg_max({{'x': gap}}, rn).x AS gap FROM g GROUP BY ALL),
k AS (SELECT *, CASE WHEN n_words >= 15 THEN 'max_words' WHEN t1 - t0 >= 8 THEN 'max_duration' WHEN soft THEN 'sentence_pause' END AS s FROM h)
SELECT media_id, CAST(fragment AS INTEGER) AS fragment, CAST(n_words AS INTEGER) AS n_words, first_id, CAST(round(t0 * 1000) AS BIGINT) AS t0_ms, CAST(round(t1 * 1000) AS BIGINT) AS t1_ms, speaker, coalesce(s, nh, 'final') AS reason, CAST(round(CASE WHEN s IS NULL THEN 0 ELSE coalesce(gap, 0) END * 1000) AS BIGINT) AS pause_ms,
coalesce(lag(s IS NULL AND nh IS NOT NULL) OVER (PARTITION BY media_id ORDER BY fragment), false) AS split_before FROM k""")
def build_fragments(spark, d):
    k = F.col("k")
    w = _words(spark, d).withColumn("clip", F.format_string("c%d-%d", "turn", F.floor(k / 20).cast("int"))).withColumn("speaker", F.when(k % 5 < 4, (F.floor(k / 11) % 3).cast("int")))
    w = w.withColumn("confirmed", k % 4 < 3).withColumn("overlap", k % 41 == 40).withColumn("language", F.lit("x"))
    f = op.build_fragments(w, M)
    return f.select("media_id", "fragment", F.size("word_ids").alias("n_words"), F.col("word_ids")[0].alias("first_id"), *_ms("t0", "t1"), "speaker", "reason", *_ms("pause"), "split_before")


@query()
def split_long_cues(spark, d):
    """Turns of conversations as cues cut to readable ones: loops over each cue's utterances and parts, held by tests against a loop."""
    w = _words(spark, d)
    cues = w.groupBy("media_id", "turn").agg(F.min("t0").alias("t0"), F.max("t1").alias("t1"), F.sort_array(F.collect_list(F.struct("k", "text", F.col("t0").alias("a"), F.col("t1").alias("z")))).alias("w"))
    words = F.transform("w", lambda x: F.struct(x["text"], (x["a"] - F.col("t0")).alias("start"), (x["z"] - F.col("t0")).alias("end")))
    cues = cues.select("media_id", F.col("turn").alias("id"), "t0", "t1", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("text"), words.alias("words"))
    c = cu.split_long(cues, M)
    return c.select("media_id", "cue", "id", *_ms("t0", "t1"), "text", F.size("words").alias("n_words"))
