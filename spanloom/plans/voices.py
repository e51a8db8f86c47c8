"""Queries on speakers of two sources and on the noise of frames."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clusters as cl
from ..operators import frames as fr
from ..operators import speakers as sp
from ..sources.tables import table
from .energy import FRAMES, frames
from .registry import HOUR, MS, M, _ms, _of, query

SIDES = """ev AS (SELECT id, media_id, t0, t1, CASE WHEN id % 7 > 0 THEN id % 3 END AS label FROM s WHERE speaker = 'click'), tu AS (SELECT media_id, id % 2 + 10 AS speaker, t0, t1 FROM s WHERE speaker <> 'click'),
sh AS (SELECT ev.media_id, speaker, label, sum(least(ev.t1, tu.t1) - greatest(ev.t0, tu.t0)) AS v FROM ev JOIN tu ON ev.media_id = tu.media_id AND ev.t0 < tu.t1 AND tu.t0 < ev.t1 WHERE label IS NOT NULL GROUP BY ALL HAVING sum(least(ev.t1, tu.t1) - greatest(ev.t0, tu.t0)) > 0),
rk AS (SELECT *, row_number() OVER (PARTITION BY media_id ORDER BY v DESC, speaker DESC, label DESC) AS n FROM sh),
gr AS (SELECT media_id, n, [speaker] AS sp, [label] AS la FROM rk WHERE n = 1 UNION ALL SELECT rk.media_id, rk.n, CASE WHEN free THEN list_append(sp, speaker) ELSE sp END, CASE WHEN free THEN list_append(la, label) ELSE la END
FROM (SELECT rk.media_id, rk.n, speaker, label, sp, la, NOT list_contains(sp, speaker) AND NOT list_contains(la, label) AS free FROM gr JOIN rk ON gr.media_id = rk.media_id AND rk.n = gr.n + 1) rk),
mp AS (SELECT media_id, unnest(sp) AS speaker, unnest(la) AS label FROM (SELECT media_id, arg_max(sp, n) AS sp, arg_max(la, n) AS la FROM gr GROUP BY media_id) JOIN (SELECT media_id, count(DISTINCT speaker) AS k FROM tu GROUP BY media_id) USING (media_id) WHERE len(sp) = k)"""


def _sides(spark, d):
    i = F.col("id")
    events = _of(spark, d, "click").select("id", "media_id", "t0", "t1", F.when(i % 7 > 0, i % 3).alias("label"))
    return events, _of(spark, d, "click", True).select("media_id", (i % 2 + 10).alias("speaker"), "t0", "t1")


@query(f"WITH RECURSIVE {{S}}, {SIDES} SELECT media_id, speaker, label FROM mp")
def map_speakers(spark, d):
    events, turns = _sides(spark, d)
    return sp.map_speakers(turns, events, M, 6 * HOUR)


@query(f"""WITH RECURSIVE {{S}}, {SIDES}, hd AS (SELECT ev.id, max_by(speaker, (tu.t1 - tu.t0, -tu.t0, speaker)) AS g FROM ev JOIN tu ON ev.media_id = tu.media_id AND tu.t0 <= (ev.t0 + ev.t1) / 2 AND (ev.t0 + ev.t1) / 2 < tu.t1 GROUP BY ev.id),
j AS (SELECT ev.*, g, mp.label AS mapped FROM ev LEFT JOIN hd USING (id) LEFT JOIN mp ON ev.media_id = mp.media_id AND g = mp.speaker),
f AS (SELECT *, CASE WHEN g IS NOT NULL AND label IS NOT NULL AND mapped <> label THEN 'unknown' WHEN g IS NOT NULL AND label IS NOT NULL AND mapped IS NOT NULL THEN 'fused' WHEN g IS NOT NULL THEN 'global' WHEN label IS NOT NULL THEN 'embedding' ELSE 'unknown' END AS source FROM j),
h AS (SELECT *, CASE source WHEN 'fused' THEN mapped WHEN 'global' THEN g WHEN 'embedding' THEN label END AS who FROM f), k AS (SELECT *, dense_rank() OVER (PARTITION BY media_id ORDER BY who NULLS LAST) - 1 AS r FROM h)
SELECT id, source, CAST(CASE WHEN who IS NOT NULL THEN r END AS INTEGER) AS speaker, CASE WHEN who IS NOT NULL THEN 'Speaker ' || chr(CAST(65 + r AS INTEGER)) END AS name, CASE WHEN source <> 'unknown' THEN '' WHEN g IS NOT NULL AND label IS NOT NULL THEN 'speaker_evidence_conflict' ELSE 'speaker_evidence_unavailable' END AS repair FROM k""")
def fuse_speakers(spark, d):
    events, turns = _sides(spark, d)
    return sp.fuse_speakers(events, turns, M, 6 * HOUR).select("id", "source", "speaker", "name", "repair")


@query("""WITH e AS (SELECT label AS media_id, vec_id AS id, CASE WHEN vec_id % 9 > 0 THEN list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END AS v, vec_id * 1000 / 1000 AS t0, (vec_id * 1000 + 900 + vec_id % 5 * 100) / 1000 AS t1 FROM embeddings),
l AS (SELECT *, lag(v) OVER w AS p, lag(t1) OVER w AS z FROM e WINDOW w AS (PARTITION BY media_id ORDER BY t0, t1, id)),
q AS (SELECT media_id, t0, z, 1 - list_dot_product(p, v) / (sqrt(list_dot_product(p, p)) * sqrt(list_dot_product(v, v))) AS d FROM l WHERE p IS NOT NULL AND v IS NOT NULL),
k AS (SELECT media_id, CASE WHEN t0 > z THEN z ELSE t0 END AS edge, 0.4::DOUBLE * greatest(0, least(2, d)) + 0.2::DOUBLE * least(1, greatest(0, t0 - z) / 0.25::DOUBLE) AS score FROM q)
SELECT media_id, CAST(round(edge * 1000) AS BIGINT) AS at_ms, round(score, 6) AS score FROM k WHERE score >= 0.6""")
def voice_changes(spark, d):
    i = F.col("vec_id")
    v = F.when(i % 9 > 0, F.transform("embedding", lambda x: x.cast("double")))
    words = table(spark, d, "embeddings").select(F.col("label").alias("media_id"), i.alias("id"), v.alias("v"), (i * 1000 / 1000).alias("t0"), ((i * 1000 + 900 + i % 5 * 100) / 1000).alias("t1"))
    return sp.voice_changes(words, M, 0.6).select("media_id", *_ms("at"), F.round("score", 6).alias("score"))


@query("WITH RECURSIVE {S}, " + FRAMES + f""", x AS (SELECT media_id, k, greatest(1, least(40, rms)) AS rms FROM f), n AS (SELECT media_id, max(k) AS top FROM x GROUP BY media_id),
v AS (SELECT x.media_id, i AS n, rms, k FROM x JOIN n USING (media_id), range(0, 100000) r(i) WHERE i * 4 <= k AND k < i * 4 + 8 AND i * 4 <= top),
m AS (SELECT media_id, n, count(*) AS frames, quantile_cont(rms, 0.5) AS med, quantile_cont(20 * log10(rms), 0.25) AS q FROM v GROUP BY ALL),
g AS (SELECT media_id, n, frames, med, q, quantile_cont(abs(rms - med), 0.5) * 1.4826::DOUBLE AS mad FROM m JOIN v USING (media_id, n) GROUP BY ALL),
w AS (SELECT media_id, n, n * 2.0::DOUBLE AS t0, (n * 4 + frames) * 0.5::DOUBLE AS t1, med AS rms, mad, CASE WHEN frames >= 4 THEN q ELSE 5 END AS db, frames >= 4 AS stable, frames, n = max(n) OVER (PARTITION BY media_id) AS final FROM g),
r AS (SELECT media_id, n, 1 AS no, t0, t1, rms, mad, CAST(db AS DOUBLE) AS db, stable, frames FROM w WHERE n = 0 UNION ALL
SELECT w.media_id, w.n, CASE WHEN near OR NOT far THEN no ELSE no + 1 END, CASE WHEN near OR NOT far THEN r0 ELSE w.t0 END, CASE WHEN near OR far THEN w.t1 ELSE r1 END, CASE WHEN near THEN (rr * rf + w.rms * w.frames) / (rf + w.frames) WHEN far THEN w.rms ELSE rr END,
CASE WHEN near THEN greatest(rm, w.mad) WHEN far THEN w.mad ELSE rm END, CASE WHEN near THEN (rd * rf + w.db * w.frames) / (rf + w.frames) WHEN far THEN w.db ELSE rd END, CASE WHEN near THEN rs AND w.stable WHEN far THEN w.stable ELSE rs END, CASE WHEN near THEN rf + w.frames WHEN far THEN w.frames ELSE rf END
FROM (SELECT w.*, r.no, r.t0 AS r0, r.t1 AS r1, r.rms AS rr, r.mad AS rm, r.db AS rd, r.stable AS rs, r.frames AS rf, abs(w.db - r.db) < 3 AS near, w.t1 - r.t1 >= 2 OR w.final AS far FROM r JOIN w ON w.media_id = r.media_id AND w.n = r.n + 1) w)
SELECT media_id, {MS.format("t0")}, {MS.format("t1")}, round(rms, 6) AS rms, round(mad, 6) AS mad, round(db, 6) AS db, stable, frames FROM r QUALIFY row_number() OVER (PARTITION BY media_id, no ORDER BY n DESC) = 1""")
def noise_profile(spark, d):
    p = fr.noise_profile(frames(spark, d), M, 0.5, 8, 4, 3.0, 2.0, 5.0, 1.0, 40.0)
    return p.select("media_id", *_ms("t0", "t1"), *[F.round(c, 6).alias(c) for c in ("rms", "mad", "db")], "stable", "frames")


@query()
def voice_groups(spark, d):
    """Vectors grouped within their label by average linkage; tests hold the operator against all pairwise distances."""
    v = table(spark, d, "embeddings").select(F.col("label").alias("media_id"), F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v"))
    return cl.voice_groups(v, M, below=0.8).select("media_id", "id", "cluster", F.round("silhouette", 6).alias("silhouette"))
