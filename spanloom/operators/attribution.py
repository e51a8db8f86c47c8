"""From aligned pairs to parameter steps: what changed, which parameters that speaks for, which of coupled ones move, and by how much."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .feedback import learn_rate

#: Parameters that must not move together, in the order in which they are looked at.
COUPLED = (
    ("merge_decision.fast_merge_max_gap", "merge_decision.llm_decision_min_gap"),
    ("merge_decision.llm_decision_min_gap", "merge_decision.llm_decision_max_gap"),
    ("merging.padding", "merging.padding_max"),
)
STEP = "struct<param:string,tier:string,observed:double,confidence:double,weight:double,direction:string>"


def differences(pairs: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per ``by`` what pairs (match_type, auto, manual: arrays of struct<start, end>) show: counts, medians and whether the revision is structural.

    ``shift0``, ``shift1``: median seconds by which starts and ends of one-to-one pairs move, of those where one moves over 10 ms; ``longer``: by how
    much the median manual length exceeds the median automatic one; ``gap``: the longest pause inside a merge.
    """
    matched = ~F.col("match_type").isin("INSERT", "DELETE")
    one = (F.col("match_type") == "1:1") & (F.size("auto") > 0) & (F.size("manual") > 0)
    a, m = F.get("auto", F.lit(0)), F.get("manual", F.lit(0))
    d0, d1 = m["start"] - a["start"], m["end"] - a["end"]
    moved = one & ((F.abs(d0) > 0.01) | (F.abs(d1) > 0.01))
    joins, parts = (F.size("auto") > 1) & (F.size("manual") == 1), (F.size("auto") == 1) & (F.size("manual") > 1)
    n = F.size("auto")
    gaps = F.zip_with(F.slice("auto", F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice("auto", F.lit(2), F.greatest(n - 1, F.lit(0))), lambda x, y: y["start"] - x["end"])
    when = lambda c, v: F.when(c, v)
    g = pairs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if(matched).alias("matched"), F.count_if(moved).alias("shifts"), F.count_if(joins).alias("merges"), F.count_if(parts).alias("splits"), F.count_if(~matched).alias("unmatched"),
        F.median(when(moved, d0)).alias("shift0"), F.median(when(moved, d1)).alias("shift1"), F.max(when(joins, F.array_max(gaps))).alias("gap"),
        (F.median(when(one, m["end"] - m["start"])) - F.median(when(one, a["end"] - a["start"]))).alias("longer"),
    )
    return g.withColumn("coverage", F.col("matched") / F.col("pairs")).withColumn("structural", F.col("unmatched") > F.col("pairs") * 0.3)


def attribute(report: DataFrame, by: Sequence[str], isolate: bool = True) -> DataFrame:
    """(by, param, tier, observed, confidence, weight, direction): the parameters that ``differences`` speak for.

    Late ends and early starts over 50 ms ask for padding (starts count if both do), merges and splits of over 15 % of the matched pairs for wider
    and narrower gaps (with ``isolate`` the surer of both), a median length off by over half a second for another longest cue.
    """

    def step(param: str, tier: str, observed: Column, full: float, weight: float, direction: Column | str) -> Column:
        direction = F.lit(direction) if isinstance(direction, str) else direction
        return F.struct(
            F.lit(param).alias("param"), F.lit(tier).alias("tier"), observed.alias("observed"), F.least(F.lit(1.0), observed / full).alias("confidence"), F.lit(weight).alias("weight"), direction.alias("direction")
        ).cast(STEP)

    s0, s1, longer = F.col("shift0"), F.col("shift1"), F.col("longer")
    of = lambda c: F.col(c) / F.greatest(F.col("matched"), F.lit(1))
    padding = F.when(s0 < -0.05, step("merging.padding", "short_term", -s0, 0.15, 0.8, "increase")).when(s1 > 0.05, step("merging.padding", "short_term", s1, 0.2, 0.8, "increase"))
    wide, narrow = of("merges") > 0.15, of("splits") > 0.15
    wider = F.least(F.lit(1.0), of("merges") / 0.3) >= F.least(F.lit(1.0), of("splits") / 0.3)
    keep_wide, keep_narrow = (wide & (~narrow | wider), narrow & (~wide | ~wider)) if isolate else (wide, narrow)
    steps = F.array(
        padding, F.when(keep_wide, step("merge_decision.fast_merge_max_gap", "medium_term", of("merges"), 0.3, 1.0, "increase")),
        F.when(keep_narrow, step("merge_decision.llm_decision_max_gap", "medium_term", of("splits"), 0.3, 1.0, "decrease")),
        F.when(F.abs(longer) > 0.5, step("subtitle.max_duration", "long_term", F.abs(longer), 2.0, 0.7, F.when(longer < 0, "decrease").otherwise("increase"))),
    )
    return report.select(*by, F.inline(F.filter(steps, lambda x: x.isNotNull())))


def select_steps(steps: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of each coupled pair that still has both of its parameters, in the order of COUPLED, the surer step stays (the first at a tie)."""
    fields = [c for c in steps.columns if c not in by]
    lists = steps.groupBy(*by).agg(F.collect_list(F.struct(*fields)).alias("_steps"))

    def confidence(param: str) -> Column:
        return F.array_max(F.transform(F.filter("_steps", lambda s: s["param"] == param), lambda s: s["confidence"]))

    for a, b in COUPLED:
        sure = {p: confidence(p) for p in (a, b)}
        out = F.when(sure[a] >= sure[b], b).when(sure[a] < sure[b], a)
        lists = lists.withColumn("_out", out).withColumn("_steps", F.filter("_steps", lambda s: ~s["param"].eqNullSafe(F.col("_out")))).drop("_out")
    return lists.select(*by, F.inline("_steps"))


def learn(steps: DataFrame, values: DataFrame, by: Sequence[str], bounds: Mapping[str, tuple[float, float]], least: float = 0.001) -> DataFrame:
    """(by, param, value, new): values (by, param, value, samples) moved towards what their steps ask for, inside their bounds.

    The rate follows the number of feedback samples and the step's weight. Changes under ``least`` and parameters without a value are left out.
    """
    met = steps.join(values, [*by, "param"])
    sign = F.when(F.col("direction") == "increase", 1.0).otherwise(-1.0)
    target = F.col("value") + sign * F.col("observed") * F.col("weight")
    moved = F.col("value") + (target - F.col("value")) * learn_rate(F.col("samples")) * F.col("weight")
    ends = F.create_map(*[F.lit(x) for p, (low, high) in bounds.items() for x in (p, [low, high])]) if bounds else None
    held = moved if ends is None else F.when(F.element_at(ends, F.col("param")).isNull(), moved).otherwise(F.greatest(F.element_at(ends, F.col("param"))[0], F.least(F.element_at(ends, F.col("param"))[1], moved)))
    return met.select(*by, "param", "value", held.alias("new")).where(F.abs(F.col("new") - F.col("value")) >= least)
