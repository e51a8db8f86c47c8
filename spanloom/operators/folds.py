"""Order-dependent merging as folds over sorted arrays.

A fold's state is what it last emitted, so window functions cannot express it. Runs are cut first where the gap to all
earlier spans of the key is so long that no rule reaches over it; each run is one array, so a fold's memory follows the
longest run and not the whole recording.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ORDER = ("t0", "t1", "id")


def runs(spans: DataFrame, by: Sequence[str], gap: float, fields: Sequence[str]) -> DataFrame:
    """by, run, items: the spans of a run as structs in time order; a new run starts ``gap`` or more after all before it."""
    w = W.partitionBy(*by).orderBy(*ORDER)
    reach = F.max("t1").over(w.rowsBetween(W.unboundedPreceding, -1))
    fresh = spans.withColumn("_n", F.coalesce((F.col("t0") - reach >= gap).cast("int"), F.lit(0)))
    cut = fresh.withColumn("run", F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return cut.groupBy(*by, "run").agg(F.array_sort(F.collect_list(F.struct(*ORDER, *fields))).alias("items"))


def _replace_last(out: Column, item: Column) -> Column:
    return F.concat(F.slice(out, 1, F.size(out) - 1), F.array(item))


def fold(run: DataFrame, by: Sequence[str], first: Callable[[Column], Column], joins: Callable[[Column, Column], Column], merge: Callable[[Column, Column], Column]) -> DataFrame:
    """Fold items into groups: ``joins(last, item)`` decides whether ``merge(last, item)`` replaces the last group or a new one starts."""
    start = F.array(first(F.col("items")[0]))

    def step(out: Column, item: Column) -> Column:
        last = F.element_at(out, -1)
        return F.when(joins(last, item), _replace_last(out, merge(last, item))).otherwise(F.concat(out, F.array(first(item))))

    folded = F.aggregate(F.slice("items", 2, F.greatest(F.size("items") - 1, F.lit(0))), start, step)
    return run.select(*by, F.inline(folded))


def merge_short(spans: DataFrame, by: Sequence[str], shortest: float, gap: float) -> DataFrame:
    """A cue joins the one before it if either is under ``shortest``, both have one speaker and the gap is under ``gap``.

    The end of a merged cue is the end of its last member, and its length decides on the next one.
    """
    g = lambda t0, t1, who, n: F.struct(t0.alias("t0"), t1.alias("t1"), who.alias("speaker"), n.alias("members"))
    short = lambda x: x["t1"] - x["t0"] < shortest
    return fold(
        runs(spans, by, gap, ["speaker"]), by,
        lambda x: g(x["t0"], x["t1"], x["speaker"], F.lit(1)),
        lambda p, x: (short(p) | short(x)) & (x["t0"] - p["t1"] < gap) & p["speaker"].eqNullSafe(x["speaker"]),
        lambda p, x: g(p["t0"], x["t1"], p["speaker"], p["members"] + 1),
    )


def drop_adjacent_repeats(segments: DataFrame, by: Sequence[str], gap: float) -> DataFrame:
    """Of neighbours within ``gap`` whose texts (``text``) are equal or contain each other, keep the longer text, then the longer span, then the earlier."""
    g = lambda x: F.struct(x["id"].alias("id"), x["t0"].alias("t0"), x["t1"].alias("t1"), x["text"].alias("text"))
    size = lambda x: F.struct(F.length(x["text"]), F.greatest(x["t1"] - x["t0"], F.lit(0.0)))
    return fold(
        runs(segments, by, gap + 1e-6, ["text"]), by, g,
        lambda p, x: (x["t0"] - p["t1"] <= gap) & (p["text"].contains(x["text"]) | x["text"].contains(p["text"])),
        lambda p, x: F.when(size(x) > size(p), g(x)).otherwise(p),
    )


def protect_fragments(spans: DataFrame, by: Sequence[str], shortest: float, gap: float) -> DataFrame:
    """Spans under ``shortest`` join the nearer neighbour closer than ``gap`` (the next one at equal distance); others stay."""
    w = W.partitionBy(*by).orderBy(*ORDER)
    ahead = spans.withColumn("n0", F.lead("t0").over(w)).withColumn("n1", F.lead("t1").over(w))
    g = lambda t0, t1: F.struct(t0.alias("t0"), t1.alias("t1"))
    empty = F.struct(F.array().cast("array<struct<t0:double,t1:double>>").alias("out"), F.lit(False).alias("skip"))
    pack = lambda out, skip: F.struct(out.alias("out"), F.lit(skip).alias("skip"))

    def step(acc: Column, x: Column) -> Column:
        out = acc["out"]
        last = F.element_at(out, -1)
        before = F.when(F.size(out) > 0, x["t0"] - last["t1"])
        after = x["n0"] - x["t1"]
        forward = (after < gap) & F.coalesce(after <= before, F.lit(True))
        back = F.coalesce(before < gap, F.lit(False))
        plain = F.concat(out, F.array(g(x["t0"], x["t1"])))
        return (
            F.when(acc["skip"], pack(out, False))
            .when(x["t1"] - x["t0"] >= shortest, pack(plain, False))
            .when(F.coalesce(forward, F.lit(False)), pack(F.concat(out, F.array(g(x["t0"], x["n1"]))), True))
            .when(back, pack(_replace_last(out, g(last["t0"], F.greatest(last["t1"], x["t1"]))), False))
            .otherwise(pack(plain, False))
        )

    # a run ends where the next start is `gap` or more after every end, so neither direction reaches over the cut
    return runs(ahead, by, gap, ["n0", "n1"]).select(*by, F.inline(F.aggregate("items", empty, step, lambda acc: acc["out"])))


def trim_overlaps(spans: DataFrame, by: Sequence[str]) -> DataFrame:
    """Each span ends where the next one kept starts; a span trimmed to nothing vanishes. Rows without length are rejected first."""
    w = W.partitionBy(*by).orderBy(*ORDER)
    # of spans with one start the last stays; the trim by the next distinct start is then a plain lead
    last = spans.where("t1 > t0").withColumn("_k", F.row_number().over(W.partitionBy(*by, "t0").orderBy(F.desc("t1"), F.desc("id")))).where("_k = 1")
    return last.withColumn("_n", F.lead("t0").over(w)).select("id", *by, "t0", F.least("t1", "_n").alias("t1"))


def repair_late(words: DataFrame, bins: DataFrame, by: Sequence[str], width: float, late: float, gap: float) -> DataFrame:
    """Words that start up to ``late`` after a bin's end move into it: id, t0, t1, repaired.

    The first such bin by start counts. The word then spans from the repaired end of the word before it (if within
    ``gap``) or the bin's start, whichever is later, to the bin's end.
    """
    b = bins.select(*by, F.col("t0").alias("b0"), F.col("t1").alias("b1"), F.explode(F.sequence(F.floor(F.col("t1") / width).cast("long"), F.floor((F.col("t1") + late) / width).cast("long"))).alias("_b"))
    near = words.withColumn("_b", F.floor(F.col("t0") / width).cast("long")).join(b, [*by, "_b"]).where((F.col("t0") >= F.col("b1")) & (F.col("t0") - F.col("b1") <= late))
    pick = near.groupBy("id").agg(F.min(F.struct("b0", "b1")).alias("bin"))
    rows = words.join(pick, "id", "left").select("id", *by, "t0", "t1", F.col("bin.b0").alias("b0"), F.col("bin.b1").alias("b1"))
    empty = F.array().cast("array<struct<id:bigint,t0:double,t1:double,repaired:boolean>>")
    g = lambda i, t0, t1, r: F.array(F.struct(i.alias("id"), t0.alias("t0"), t1.alias("t1"), F.lit(r).alias("repaired")))

    def step(out: Column, x: Column) -> Column:
        before = F.when(F.size(out) > 0, F.element_at(out, -1)["t1"])
        start = F.greatest(x["b0"], F.when(x["t0"] - before <= gap, before))
        fits = x["b1"].isNotNull() & (start < x["b1"])
        return F.concat(out, F.when(fits, g(x["id"], start, x["b1"], True)).otherwise(g(x["id"], x["t0"], x["t1"], False)))

    return runs(rows, by, gap + 2 * late, ["b0", "b1"]).select(*by, F.inline(F.aggregate("items", empty, step)))
