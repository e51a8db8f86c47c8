"""Queries from aligned pairs to parameter steps; an event is a pair whose other side follows from its id."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import attribution as at
from ..sources.tables import spans
from .registry import M, query

PAIRS = """k AS (SELECT *, (t0 + t1) / 2 AS mid, (id * 7 + media_id) % (4 + media_id % 4) AS kind, (media_id % 5 - 3) * 0.03::DOUBLE AS s, (media_id % 6 - 2) * 0.04::DOUBLE + id % 3 * 0.01::DOUBLE AS e FROM s),
one AS (SELECT media_id, (t0 + s) - t0 AS d0, (t1 + e) - t1 AS d1, (t1 + e) - (t0 + s) AS ml, t1 - t0 AS al FROM k WHERE kind > 2),
c AS (SELECT media_id, count(*) AS pairs, count_if(kind <> 2) AS matched, count_if(kind = 1) AS merges, count_if(kind = 0) AS splits, count_if(kind = 2) AS unmatched, max(CASE WHEN kind = 1 THEN (mid + 1) - mid END) AS gap FROM k GROUP BY media_id),
m AS (SELECT media_id, count_if(abs(d0) > 0.01::DOUBLE OR abs(d1) > 0.01::DOUBLE) AS shifts, median(d0) FILTER (abs(d0) > 0.01::DOUBLE OR abs(d1) > 0.01::DOUBLE) AS shift0, median(d1) FILTER (abs(d0) > 0.01::DOUBLE OR abs(d1) > 0.01::DOUBLE) AS shift1, median(ml) - median(al) AS longer FROM one GROUP BY media_id),
r AS (SELECT c.*, coalesce(shifts, 0) AS shifts, shift0, shift1, longer, matched / pairs AS coverage, unmatched > pairs * 0.3::DOUBLE AS structural FROM c LEFT JOIN m USING (media_id)),
q AS (SELECT *, merges / greatest(matched, 1) AS mr, splits / greatest(matched, 1) AS sr FROM r),
st AS (SELECT media_id, 'merging.padding' AS param, CASE WHEN shift0 < -0.05::DOUBLE THEN -shift0 ELSE shift1 END AS observed, CASE WHEN shift0 < -0.05::DOUBLE THEN least(1, -shift0 / 0.15::DOUBLE) ELSE least(1, shift1 / 0.2::DOUBLE) END AS confidence, 0.8::DOUBLE AS weight, 'increase' AS direction FROM q WHERE shift0 < -0.05::DOUBLE OR shift1 > 0.05::DOUBLE
UNION ALL SELECT media_id, 'merge_decision.fast_merge_max_gap', mr, least(1, mr / 0.3::DOUBLE), 1, 'increase' FROM q WHERE mr > 0.15::DOUBLE AND (sr <= 0.15::DOUBLE OR least(1, mr / 0.3::DOUBLE) >= least(1, sr / 0.3::DOUBLE))
UNION ALL SELECT media_id, 'merge_decision.llm_decision_max_gap', sr, least(1, sr / 0.3::DOUBLE), 1, 'decrease' FROM q WHERE sr > 0.15::DOUBLE AND (mr <= 0.15::DOUBLE OR least(1, mr / 0.3::DOUBLE) < least(1, sr / 0.3::DOUBLE))
UNION ALL SELECT media_id, 'subtitle.max_duration', abs(longer), least(1, abs(longer) / 2), 0.7::DOUBLE, CASE WHEN longer < 0 THEN 'decrease' ELSE 'increase' END FROM q WHERE abs(longer) > 0.5::DOUBLE)"""


def _pairs(spark, d):
    i, m, t0, t1 = (F.col(c) for c in ("id", "media_id", "t0", "t1"))
    one = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    mid = (t0 + t1) / 2
    kind = (i * 7 + m) % (4 + m % 4)
    whole, halves = F.array(one(t0, t1)), F.array(one(t0, mid), one(mid, t1))
    none = F.slice(whole, 1, 0)
    moved = F.array(one(t0 + (m % 5 - 3) * 0.03, t1 + ((m % 6 - 2) * 0.04 + i % 3 * 0.01)))
    auto = F.when(kind == 1, F.array(one(t0, mid), one(mid + 1, t1))).when(kind == 2, none).otherwise(whole)
    manual = F.when(kind == 0, halves).when(kind < 3, whole).otherwise(moved)
    name = F.when(kind == 0, "1:N").when(kind == 1, "N:1").when(kind == 2, "DELETE").otherwise("1:1")
    return spans(spark, d).select("media_id", name.alias("match_type"), auto.alias("auto"), manual.alias("manual"))


@query(f"WITH {{S}}, {PAIRS} SELECT media_id, pairs, matched, shifts, merges, splits, unmatched, round(shift0, 5) AS shift0, round(shift1, 5) AS shift1, round(longer, 5) AS longer, round(gap, 5) AS gap, round(coverage, 6) AS coverage, structural FROM r")
def pair_differences(spark, d):
    r = at.differences(_pairs(spark, d), M)
    return r.select("media_id", "pairs", "matched", "shifts", "merges", "splits", "unmatched", *[F.round(c, 5).alias(c) for c in ("shift0", "shift1", "longer", "gap")], F.round("coverage", 6).alias("coverage"), "structural")


@query(f"WITH {{S}}, {PAIRS} SELECT media_id, param, direction, round(observed, 5) AS observed, round(confidence, 5) AS confidence FROM st")
def attributed_steps(spark, d):
    s = at.attribute(at.differences(_pairs(spark, d), M), M)
    return s.select("media_id", "param", "direction", F.round("observed", 5).alias("observed"), F.round("confidence", 5).alias("confidence"))


@query(f"""WITH {{S}}, {PAIRS}, u AS (SELECT media_id, param, observed, confidence, weight, direction FROM st UNION ALL SELECT media_id, 'merging.padding_max', 0.1, 0.4, 0.5, 'increase' FROM r WHERE media_id % 2 = 0
UNION ALL SELECT media_id, 'merge_decision.llm_decision_min_gap', 0.2, 0.9, 1, 'decrease' FROM r WHERE media_id % 3 = 0),
p AS (SELECT media_id, max(confidence) FILTER (param = 'merge_decision.fast_merge_max_gap') AS a, max(confidence) FILTER (param = 'merge_decision.llm_decision_min_gap') AS b, max(confidence) FILTER (param = 'merge_decision.llm_decision_max_gap') AS c,
max(confidence) FILTER (param = 'merging.padding') AS x, max(confidence) FILTER (param = 'merging.padding_max') AS y FROM u GROUP BY media_id),
p2 AS (SELECT *, CASE WHEN a >= b THEN NULL ELSE b END AS b2 FROM p),
g AS (SELECT media_id, CASE WHEN a >= b THEN 'merge_decision.llm_decision_min_gap' WHEN a < b THEN 'merge_decision.fast_merge_max_gap' END AS o1, CASE WHEN b2 >= c THEN 'merge_decision.llm_decision_max_gap' WHEN b2 < c THEN 'merge_decision.llm_decision_min_gap' END AS o2,
CASE WHEN x >= y THEN 'merging.padding_max' WHEN x < y THEN 'merging.padding' END AS o3 FROM p2),
l AS (SELECT u.*, 0.5::DOUBLE + media_id % 4 * 0.1::DOUBLE AS value, CASE WHEN media_id % 20 <= 2 THEN 0 WHEN media_id % 20 <= 5 THEN 0.15::DOUBLE WHEN media_id % 20 <= 15 THEN 0.25::DOUBLE ELSE 0.35::DOUBLE END AS rate FROM u JOIN g USING (media_id) WHERE param IS DISTINCT FROM o1 AND param IS DISTINCT FROM o2 AND param IS DISTINCT FROM o3),
z AS (SELECT *, value + (value + CASE WHEN direction = 'increase' THEN 1 ELSE -1 END * observed * weight - value) * rate * weight AS n FROM l), h AS (SELECT *, CASE WHEN param = 'merge_decision.fast_merge_max_gap' THEN greatest(0.1::DOUBLE, least(0.6::DOUBLE, n)) ELSE n END AS new FROM z)
SELECT media_id, param, round(value, 5) AS value, round(new, 5) AS new FROM h WHERE abs(new - value) >= 0.001::DOUBLE""")
def learned_parameters(spark, d):
    report = at.differences(_pairs(spark, d), M)
    more = lambda param, observed, confidence, weight, direction: report.select("media_id", F.lit(param).alias("param"), F.lit("x").alias("tier"), F.lit(observed).alias("observed"), F.lit(confidence).alias("confidence"), F.lit(weight).alias("weight"), F.lit(direction).alias("direction"))
    steps = at.attribute(report, M).unionByName(more("merging.padding_max", 0.1, 0.4, 0.5, "increase").where("media_id % 2 = 0")).unionByName(more("merge_decision.llm_decision_min_gap", 0.2, 0.9, 1.0, "decrease").where("media_id % 3 = 0"))
    m = F.col("media_id")
    chosen = at.select_steps(steps, M)
    values = chosen.select("media_id", "param", (0.5 + m % 4 * 0.1).alias("value"), (m % 20).alias("samples"))
    return at.learn(chosen, values, M, {"merge_decision.fast_merge_max_gap": (0.1, 0.6)}).select("media_id", "param", F.round("value", 5).alias("value"), F.round("new", 5).alias("new"))
