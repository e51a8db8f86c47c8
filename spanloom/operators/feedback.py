"""Scores, gates and learning rules over aligned pairs and parameter histories."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Shares of coverage, text, time and structure in the health score, and the lower ends of its grades.
HEALTH = {"coverage": 0.35, "semantic": 0.35, "time": 0.20, "structure": 0.10}
GRADES = ((85.0, "excellent"), (70.0, "good"), (50.0, "fair"))


def pair_sides(left: DataFrame, right: DataFrame, links: DataFrame, by: Sequence[str]) -> DataFrame:
    """Full outer pairing: links (id, r_id, …) with match_type, plus INSERT rows (left only) and DELETE rows (right only)."""
    deg = lambda c: F.count(F.lit(1)).over(W.partitionBy(c))
    kind = F.when((F.col("_l") == 1) & (F.col("_r") == 1), "1:1").when(F.col("_l") == 1, "N:1").when(F.col("_r") == 1, "1:N").otherwise("N:M")
    linked = links.withColumn("_l", deg("id")).withColumn("_r", deg("r_id")).withColumn("match_type", kind).drop("_l", "_r")
    alone = left.join(links.select("id").distinct(), "id", "left_anti").select(*by, "id", F.lit("INSERT").alias("match_type"))
    missed = right.select(*by, F.col("id").alias("r_id")).join(links.select("r_id").distinct(), "r_id", "left_anti").select(*by, "r_id", F.lit("DELETE").alias("match_type"))
    return linked.unionByName(alone, allowMissingColumns=True).unionByName(missed, allowMissingColumns=True)


def health(pairs: DataFrame, sizes: DataFrame, by: Sequence[str]) -> DataFrame:
    """Score 0 to 100 per key from pairs (match_type, iou, sim) and sizes (n_auto, n_manual).

    The coverage counts INSERT and DELETE pairs too; text and time means leave out zeros; without pairs all is 0.
    """
    matched = ~F.col("match_type").isin("INSERT", "DELETE")
    mean = lambda c: F.coalesce(F.avg(F.when(matched & (F.col(c) > 0), F.col(c))), F.lit(0.0)) * 100
    p = pairs.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), mean("sim").alias("semantic"), mean("iou").alias("time"), (F.avg((F.col("match_type") == "1:1").cast("int")) * 100).alias("structure"))
    j = sizes.join(p, [*by], "left").fillna(0, ["_n", "semantic", "time", "structure"])
    j = j.withColumn("coverage", F.col("_n") / F.greatest("n_auto", "n_manual", F.lit(1)) * 100)
    return j.withColumn("health", sum((F.col(k) * w for k, w in HEALTH.items()), F.lit(0.0))).drop("_n")


def grade(score: Column) -> Column:
    out = F.lit("poor")
    for least, name in reversed(GRADES):
        out = F.when(score >= least, name).otherwise(out)
    return out


def gate(metrics: DataFrame, rules: dict[str, tuple[str, str, float]]) -> DataFrame:
    """reasons: names of the rules (column, 'min' or 'max', limit) that a row breaks; eligible: none. A null value breaks its rule."""
    broken = [F.when(F.coalesce((F.col(c) < v) if way == "min" else (F.col(c) > v), F.lit(True)), F.lit(name)) for name, (c, way, v) in rules.items()]
    return metrics.withColumn("reasons", F.array_compact(F.array(*broken))).withColumn("eligible", F.size("reasons") == 0)


#: Sample counts up to which the learning rate holds.
RATES = ((2, 0.0), (5, 0.15), (15, 0.25))


def learn_rate(samples: Column, most: float = 0.35) -> Column:
    """A step function of the sample count, ``most`` above the last step."""
    out = F.lit(most)
    for upto, rate in reversed(RATES):
        out = F.when(samples <= upto, rate).otherwise(out)
    return out


def ema(history: DataFrame, by: Sequence[str], order: Sequence[str], value: str, rate: float, low: float, high: float) -> DataFrame:
    """Exponential moving average along ``order``, held in [low, high] at each step: by, ema, steps.

    Only a fold keeps the bound; a key's history is one array.
    """
    items = history.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("_v")))).alias("_h"))
    held = lambda x: F.greatest(F.lit(low), F.least(F.lit(high), x))
    out = F.aggregate(F.slice("_h", 2, F.greatest(F.size("_h") - 1, F.lit(0))), held(F.col("_h")[0]["_v"]), lambda a, x: held(a + (x["_v"] - a) * rate))
    return items.select(*by, out.alias("ema"), F.size("_h").alias("steps"))


def efold(age_days: Column, days: Column | float) -> Column:
    """exp(-age / days), 1 where no time is given."""
    d = days if isinstance(days, Column) else F.lit(days)
    return F.when(d.isNull(), F.lit(1.0)).otherwise(F.exp(-F.greatest(age_days, F.lit(0.0)) / d))


def mad(df: DataFrame, by: Sequence[str], value: str, scale: float = 1.4826) -> DataFrame:
    """Median and scaled median absolute deviation; the medians join back by key."""
    mid = df.groupBy(*by).agg(F.median(value).alias("median"))
    return df.join(mid, [*by]).groupBy(*by).agg(F.any_value("median").alias("median"), (F.median(F.abs(F.col(value) - F.col("median"))) * scale).alias("mad"))


def pause_thresholds(gaps: DataFrame, by: Sequence[str], value: str, least: int) -> DataFrame:
    """short, medium and long pause of each key: quartile, 60 % and 85 % of the positive gaps up to their 95 % point, in order; keys with fewer than ``least`` have none."""
    pos = gaps.where(F.col(value) > 0)
    top = pos.groupBy(*by).agg(F.percentile(value, F.lit(0.95)).alias("_top"))
    kept = pos.join(top, [*by]).where(F.col(value) <= F.col("_top"))
    q = kept.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *[F.percentile(value, F.lit(p)).alias(c) for c, p in (("short", 0.25), ("medium", 0.6), ("long", 0.85))])
    return q.where(F.col("n") >= least)


def recent_flips(history: DataFrame, by: Sequence[str], order: Sequence[Column], delta: str, last: int = 5) -> DataFrame:
    """Sign changes among the ``last`` newest deltas, zeros passed over: stable, oscillating (2) or lock (3 or more)."""
    newest = history.withColumn("_k", F.row_number().over(W.partitionBy(*by).orderBy(*[c.desc() for c in order]))).where(F.col("_k") <= last)
    signs = newest.where(F.col(delta) != 0).withColumn("_s", F.signum(delta))
    turned = signs.withColumn("_f", (F.col("_s") != F.lag("_s").over(W.partitionBy(*by).orderBy(F.desc("_k")))).cast("int"))
    n = turned.groupBy(*by).agg(F.coalesce(F.sum("_f"), F.lit(0)).alias("flips"))
    return n.withColumn("state", F.when(F.col("flips") >= 3, "lock").when(F.col("flips") >= 2, "oscillating").otherwise("stable"))


def _exact_total(value: str) -> tuple[Column, Column]:
    """The sum of doubles that stand for decimals of ten places or fewer, free of the order of rows (null if some value is none), and their count."""
    x = F.col(value).cast("double")
    d = F.col(value).try_cast("decimal(28,10)")
    near = F.coalesce(F.abs(d.cast("double") - x) <= F.abs(x) * 1e-15, F.lit(False))
    return F.when(F.bool_and(near | x.isNull()), F.sum(F.when(near, d))), F.count(x)


def shadow_verdict(runs: DataFrame, by: Sequence[str], base: str, trial: str, least: int, gain: float) -> DataFrame:
    """Whether paired runs favour the trial: enough runs and a relative gain of the mean of at least ``gain``.

    The gain of decimals comes from exact sums by one division, so a tie with ``gain`` or half of a last digit falls the same way in any order of rows.
    """
    (b, nb), (t, nt) = _exact_total(base), _exact_total(trial)
    m = runs.groupBy(*by).agg(F.count(F.when(F.col(base).isNotNull() & F.col(trial).isNotNull(), 1)).alias("runs"), F.avg(base).alias("base"), F.avg(trial).alias("trial"), b.alias("_b"), t.alias("_t"), (nb == nt).alias("_paired"))
    plain = (F.col("trial") - F.col("base")) / F.col("base")
    exact = (F.col("_t") - F.col("_b")).cast("double") / F.col("_b").cast("double")
    g = F.when(F.col("base") > 0, F.when(F.col("_paired") & (F.col("_b") > 0), F.coalesce(exact, plain)).otherwise(plain)).otherwise(0.0)
    m = m.withColumn("gain", g).drop("_b", "_t", "_paired")
    return m.withColumn("verdict", F.when(F.col("runs") < least, "wait").when(F.col("gain") >= gain, "upgrade").otherwise("keep"))


def margin_accept(ranked: DataFrame, query: str, score: str, best: float = 0.70, over_mean: float = 0.08, over_next: float = 0.05, label: str | None = None) -> DataFrame:
    """Accept a query's first hit (rank 1..k) if it is good, above the mean of its k hits and clear of the second; ``nearest`` is the first hit's ``label``."""
    first = [] if label is None else [F.max(F.when(F.col("rank") == 1, F.col(label))).alias("nearest")]
    g = ranked.groupBy(query).agg(*first, F.max(F.when(F.col("rank") == 1, F.col(score))).alias("top1"), F.max(F.when(F.col("rank") == 2, F.col(score))).alias("top2"), F.avg(score).alias("mean"))
    ok = (F.col("top1") >= best) & (F.col("top1") >= F.col("mean") + over_mean) & F.coalesce(F.col("top1") - F.col("top2") >= over_next, F.lit(True))
    return g.withColumn("accepted", ok)


#: Blocks of centroids that are broadcast, at most; parts that the vectors under a block are dealt to beyond.
BROADCAST_BLOCKS, PARTS = 16, 32


def nearest_centroids(vectors: DataFrame, centroids: DataFrame, k: int, block: int = 256) -> DataFrame:
    """The ``k`` centroids (label, c) most similar to each vector (vec_id, v): vec_id, label, cosine, rank.

    Centroids meet the vectors in blocks of about ``block``, each one array; only the best k of a block go on. A few blocks are broadcast, so
    vectors stay where they are; of more, each is dealt with its vectors to PARTS tasks. Lengths are taken once for each vector and centroid.
    """
    from ..functions.vector import dot, norm

    n = max(1, -(-centroids.count() // block))
    sized = centroids.select("label", "c", norm(F.col("c")).alias("size"))
    blocks = sized.groupBy(F.pmod(F.xxhash64("label"), F.lit(n)).cast("int").alias("_b")).agg(F.collect_list(F.struct("label", "c", "size")).alias("_cs"))
    own = vectors.select("vec_id", "v", norm(F.col("v")).alias("_size"))
    if n <= BROADCAST_BLOCKS:
        met = own.crossJoin(F.broadcast(blocks))
    else:
        parts = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        dealt = own.withColumn("_part", F.pmod(F.xxhash64("vec_id"), F.lit(PARTS)).cast("int")).withColumn("_b", parts(n))
        met = dealt.join(blocks.withColumn("_part", parts(PARTS)), ["_b", "_part"])
    # 0 where a vector is zero
    near = lambda c: F.when(F.col("_size") * c["size"] == 0, F.lit(0.0)).otherwise(dot(F.col("v"), c["c"]) / (F.col("_size") * c["size"]))
    hits = F.transform("_cs", lambda c: F.struct((-near(c)).alias("away"), c["label"].alias("label")))
    best = met.select("vec_id", F.inline(F.slice(F.sort_array(hits), 1, k)))
    r = best.withColumn("rank", F.row_number().over(W.partitionBy("vec_id").orderBy("away", "label"))).where(F.col("rank") <= k)
    return r.select("vec_id", "label", (-F.col("away")).alias("cosine"), "rank")


def quality_report(stages: DataFrame) -> DataFrame:
    """Four scores in [0, 1] with grades and issues from the counts that the stages leave; a null count means that its stage left none.

    Read are covered, bins, noise_warnings, edges_accepted, edges_rejected, words, words_rejected, windows,
    windows_failed, groups, fallbacks, speakers_retained (a share), removed, overlaps and trimmed. A score is 1 less
    0.15 for each issue, but at least 0.8 times the dimension's share: covered bins, words placed, speakers retained,
    and for structure 1 less 0.2 for each issue. Missing coverage is an issue of its own.
    """
    c = F.col
    share = lambda part, whole: part / F.greatest(whole, F.lit(1))
    coverage = share(c("covered"), c("bins"))
    issues = {
        "acoustic": {
            "missing_coverage": coverage.isNull(),
            "coverage_low": coverage < 0.5,
            "noise_warnings": c("noise_warnings") > 0,
            "acceptance_low": share(c("edges_accepted"), c("edges_accepted") + c("edges_rejected")) < 0.5,
        },
        "semantic": {"windows_failed": c("windows_failed") > 0, "fallbacks": c("fallbacks") > 0},
        "speaker": {"speaker_loss": c("speakers_retained") < 1},
        "structure": {"overlaps": c("overlaps") > 0, "trimmed": c("trimmed") > 0, "removed": c("removed") > 0},
    }
    out = stages
    for dim, rules in issues.items():
        out = out.withColumn(f"{dim}_issues", F.array_compact(F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()])))
    placed = F.round(1 - share(c("words_rejected"), c("words")), 3)
    bonus = {"acoustic": F.round(coverage, 3), "semantic": placed, "speaker": c("speakers_retained"), "structure": 1 - F.size("structure_issues") * 0.2}
    for dim, extra in bonus.items():
        base = F.greatest(F.lit(0.0), 1 - F.size(f"{dim}_issues") * 0.15)
        out = out.withColumn(dim, F.round(F.least(F.lit(1.0), F.greatest(base, F.coalesce(extra, F.lit(0.0)) * 0.8)), 3))
    return out.select("*", *[grade(F.round(c(dim) * 100, 6)).alias(f"{dim}_grade") for dim in issues])
