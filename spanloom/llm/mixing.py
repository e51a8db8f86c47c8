"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by exact length for every source. A source's target is met by whole repeats of
the source plus a rest. Of the rest, each length first gives its proportional share of documents;
a bounded-knapsack dynamic programme over the counts left closes the remaining budget exactly where
that is possible. Documents are then chosen inside each (source, length) by a seeded order, up to the
number the programme fixed, so reruns agree.

Defined cases: a null text has size 0; null is a source of its own and comes last; a source of size 0
has target 0; documents of size 0 are never taken; repeated rows each count. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ordinals, ranked, stage, words_in

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Words the knapsack closes for one source, at most; the proportional share takes the rest before it.
KNAPSACK_WORDS = 1 << 16


def fit(lengths: np.ndarray, counts: np.ndarray, budget: int) -> np.ndarray:
    """How many documents of each length to take so that their words come near ``budget``: as near as any choice does if it is KNAPSACK_WORDS / 2 or less.

    The proportional share holds back up to KNAPSACK_WORDS / 2 words of a larger one; the programme spends them.
    """
    lengths, counts = np.asarray(lengths, np.int64), np.asarray(counts, np.int64)
    taken = np.zeros(len(lengths), np.int64)
    total = int((lengths * counts).sum())
    budget = min(int(budget), total)
    if budget <= 0:
        return taken
    if budget == total:
        return counts.copy()
    held = min(budget, KNAPSACK_WORDS // 2)
    fraction, carry = (budget - held) / total, 0.0
    order = np.argsort(-lengths, kind="stable")
    for i in order:
        want = counts[i] * fraction + carry / lengths[i]
        taken[i] = min(counts[i], int(want))
        carry += (counts[i] * fraction - taken[i]) * lengths[i]
    rest = budget - int((taken * lengths).sum())
    while rest > KNAPSACK_WORDS:  # a few long documents: whole ones, longest first
        fits = [i for i in order if taken[i] < counts[i] and lengths[i] <= rest]
        if not fits:
            break
        add = min(int(counts[fits[0]] - taken[fits[0]]), rest // int(lengths[fits[0]]))
        taken[fits[0]] += add
        rest -= add * int(lengths[fits[0]])
    rest = min(rest, KNAPSACK_WORDS)
    most = 2 * rest  # further above the rest, nothing at all is nearer
    item_at, count_of = [], []
    first = np.full(most + 1, -1, np.int64)  # the item by which a sum is first reached
    reach = np.zeros(most + 1, bool)
    reach[0] = True
    for i in order:
        free = min(int(counts[i] - taken[i]), most // int(lengths[i]))
        k = 1
        while free > 0 and not reach[rest]:
            k = min(k, free)
            step = k * int(lengths[i])
            new = np.zeros_like(reach)
            new[step:] = reach[: most + 1 - step]
            new &= ~reach
            first[new] = len(item_at)
            reach |= new
            item_at.append(i)
            count_of.append(k)
            free -= k
            k *= 2
    sums = np.flatnonzero(reach)
    at = int(sums[np.argmin(np.abs(sums - rest))])
    while at:
        item = int(first[at])
        taken[item_at[item]] += count_of[item]
        at -= count_of[item] * int(lengths[item_at[item]])
    gap = budget - int((taken * lengths).sum())
    over = min((int(lengths[i]) for i in order if taken[i] < counts[i] and gap < lengths[i] < 2 * gap), default=None)
    if over is not None:  # one document longer than what is left comes nearer than none
        taken[lengths == over] += 1
    return taken


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    full = int(pdf["whole"].iloc[0])
    part = fit(pdf["size"].to_numpy(), pdf["n"].to_numpy(), int(pdf["rest"].iloc[0]))
    return pd.DataFrame({"source": pdf["source"], "size": pdf["size"], "n": pdf["n"], "whole": full, "chosen": part})


def targets(sources: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = MAX_REPEATS) -> DataFrame:
    """(source, source_size, target) for rows (source, source_size).

    A source's weight goes by its place among the names. The share of a unit of weight starts at budget / weights; sources whose
    share passes ``cap`` sizes are held there and what they leave is shared by the others, which raises the share, until none is above.
    """
    named = ordinals(sources, "source")
    held = sources.join(named, sources["source"] == named["value"], "left")
    last = held.agg(F.count("ordinal")).first()[0]
    of = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.coalesce("ordinal", F.lit(last)) % len(weights) + 1).cast("int"))
    held = stage(held.select("source", "source_size", of.alias("weight")), "mix-sources")
    most = F.lit(cap) * F.col("source_size") / F.col("weight")  # share of a unit of weight at which the source is full
    budget = float(held.agg(F.sum("source_size")).first()[0] or 0)
    share = 0.0
    while True:
        full = most < F.lit(share)
        r = held.agg(F.sum(F.when(full, cap * F.col("source_size"))).alias("spent"), F.sum(F.when(~full & (F.col("source_size") > 0), F.col("weight"))).alias("open")).first()
        new = (budget - float(r.spent or 0)) / r.open if r.open else share
        if new <= share:
            break
        share = new
    return held.select("source", "source_size", F.when(most < F.lit(share), (cap * F.col("source_size")).cast("double")).otherwise(F.col("weight") * F.lit(share)).alias("target"))


def mix_plan(sized: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = MAX_REPEATS) -> tuple[DataFrame, DataFrame]:
    """(source, source_size, target), (source, size, n, whole, chosen) for rows (source, size)."""
    hist = stage(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "mix-lengths")
    sources = stage(hist.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("long").alias("source_size")), "mix-names")
    goal = targets(sources, weights, cap)
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(cap).cast("long"), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("int")
    goal = goal.withColumn("whole", whole).withColumn("rest", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    goal = stage(goal, "mix-goal")
    asked = hist.where("size > 0").join(goal, hist["source"].eqNullSafe(goal["source"])).select(hist["source"], "size", "n", "whole", "rest")
    plan = asked.groupBy("source").applyInPandas(_plan, "source string, size long, n long, whole int, chosen long")
    return goal, plan


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = MAX_REPEATS, keep: Sequence[str] = ("doc_id",), order: Sequence[str] | None = None) -> DataFrame:
    """``keep`` columns with size, source, source_size, target, copies (times taken) and taken (words).

    The seeded choice among documents of one size goes by the columns ``order`` of ``keep`` (all of them if not given).
    """
    base = stage(docs.select(*keep, F.col("source").cast("string").alias("source"), words_in(F.col("text")).alias("size")), "mix-sizes")
    goal, plan = mix_plan(base, weights, cap)
    plan = stage(plan, "mix-plan")
    g, p = goal.select(F.col("source").alias("_s"), "source_size", "target"), plan.select(F.col("source").alias("_ps"), F.col("size").alias("_z"), "whole", "chosen", "n")
    rows = base.join(p, base["source"].eqNullSafe(F.col("_ps")) & (base["size"] == F.col("_z")), "left").drop("_ps", "_z")
    # only lengths of which a part is chosen need an order
    partial = (F.col("chosen") > 0) & (F.col("chosen") < F.col("n"))
    some = ranked(stage(rows.where(partial), "mix-partial"), ["source", "size"], [*(order or keep), "source", "size"], "_at")
    none = rows.where(~F.coalesce(partial, F.lit(False))).withColumn("_at", F.lit(0).cast("long"))
    out = some.unionByName(none).join(g, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    copies = F.coalesce(F.col("whole") + (F.col("_at") < F.col("chosen")).cast("int"), F.lit(0))
    return out.withColumn("copies", copies).withColumn("taken", (F.col("size") * F.col("copies")).cast("long")).drop("whole", "chosen", "n", "_at")
