"""Operators on timed words: word-safe cutting, language switches, candidate edges and their arbitration."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Words that may open a clause after a comma.
CLAUSE_STARTERS = "but because either for if i'm it's once or so that they're you you'll".split()
SENTENCE_END, SOFT_END = r"[.!?！？。]$", r"[,;；]$"
#: Weights of the signals in a candidate edge's score.
SIGNALS = {"asr": 0.28, "rms": 0.22, "vad": 0.16, "ffmpeg": 0.14, "noise": 0.10, "source_consistency": 0.10}


@dataclass(frozen=True)
class Limits:
    """Bounds of a cue piece: seconds and characters (two lines)."""

    silence: float = 0.35
    seconds: float = 5.0
    latin_seconds: float = 4.5
    cjk_chars: int = 40
    latin_chars: int = 84
    clause_seconds: float = 1.15
    clause_chars: int = 24
    pause: float = 0.30
    pause_after: float = 2.0


def segment_words(words: DataFrame, by: Sequence[str], limits: Limits = Limits()) -> DataFrame:
    """Cut cues at word boundaries: by, piece, t0, t1, n_words, text.

    Words are (by, pos, word, t0, t1); a cue begins at its first word. A piece ends after a sentence, at a clause
    after a comma, before a word that breaks a limit, at a silence or at a Latin pause. What a word says of itself is
    a column of its own before the fold, whose state keeps the starts of pieces and not the words. Null words count
    as empty.
    """
    word = F.coalesce(F.col("word"), F.lit(""))
    said = F.trim(word)
    bare = F.lower(F.regexp_replace(said, r"""^[\s"'(\[{“‘]+|[\s"'(\[{“‘]+$""", ""))
    marks = words.select(
        *by, "pos", word.alias("word"), "t0", "t1", F.length(F.replace(said, F.lit(" "))).alias("n"), said.rlike(SENTENCE_END).alias("ends"),
        said.rlike(SOFT_END).alias("soft"), bare.isin(CLAUSE_STARTERS).alias("opens"), F.regexp_count(word, F.lit("[A-Za-z]")).alias("_l"), F.regexp_count(word, F.lit(r"[\x{4E00}-\x{9FFF}]")).alias("_c"),
    )
    item = F.struct("pos", "word", "t0", "t1", "n", "ends", "soft", "opens")
    cues = marks.groupBy(*by).agg(F.array_sort(F.collect_list(item)).alias("_w"), (F.sum("_l") > F.sum("_c")).alias("_latin"), (F.sum("_c") > F.sum("n") * 0.5).alias("_cjk"))
    is_latin = F.col("_latin")
    chars = F.when(F.col("_cjk"), limits.cjk_chars).otherwise(limits.latin_chars)
    most = F.when(is_latin, min(limits.seconds, limits.latin_seconds)).otherwise(limits.seconds)

    def state(cuts: Column, at: Column, start: Column, size: Column, last: Column) -> Column:
        before = [last[k].alias(k) for k in ("t1", "ends", "soft")]
        return F.struct(cuts.alias("cuts"), at.cast("int").alias("at"), start.alias("start"), size.cast("int").alias("size"), *before)

    def step(s: Column, w: Column) -> Column:
        gap, held = w["t0"] - s["t1"], s["t1"] - s["start"]
        full = (held >= limits.seconds - 0.5) & (s["size"] >= limits.clause_chars)
        clause = is_latin & s["soft"] & (w["n"] > 0) & (held >= limits.clause_seconds) & (w["opens"] | full)
        over = (w["t1"] - s["start"] > most) | (s["size"] + w["n"] > chars)
        silent = ((gap < 0) | (gap > limits.silence)) & ~(is_latin & (gap <= limits.silence + 0.15) & s["soft"])
        pause = is_latin & (gap >= limits.pause) & (held >= limits.pause_after) & ~s["soft"]
        cut = s["ends"] | clause | over | silent | pause
        return F.when(cut, state(F.concat(s["cuts"], F.array(s["at"])), s["at"] + 1, w["t0"], w["n"], w)).otherwise(state(s["cuts"], s["at"] + 1, s["start"], s["size"] + w["n"], w))

    head = F.col("_w")[0]
    zero = state(F.array(F.lit(0)), F.lit(1), head["t0"], head["n"], head)
    found = cues.select(*by, "_w", F.aggregate(F.slice("_w", 2, F.greatest(F.size("_w") - 1, F.lit(0))), zero, step, lambda s: s["cuts"]).alias("_cuts"))
    to = F.concat(F.slice("_cuts", 2, F.size("_cuts")), F.array(F.size("_w")))
    parts = F.zip_with("_cuts", to, lambda a, b: F.slice("_w", a + 1, b - a))
    part = found.select(*by, F.posexplode(parts).alias("piece", "_p"))
    ends = [F.col("_p")[0]["t0"].alias("t0"), F.element_at("_p", -1)["t1"].alias("t1")]
    return part.select(*by, "piece", *ends, F.size("_p").alias("n_words"), F.array_join(F.transform("_p", lambda w: w["word"]), " ").alias("text"))


def language_switches(words: DataFrame, by: Sequence[str], drop: float = 0.3, least: int = 2) -> DataFrame:
    """Where the confidence falls (by, pos): the mean of the two words before less that of the next three exceeds ``drop``.

    A fall lasts until the difference is at most half of ``drop``, and counts from ``least`` words on. Words are
    (by, pos from 0, conf). The last signal before a word is the automaton's state, so windows express it. Keys
    with fewer than four words have none.
    """
    w = W.partitionBy(*by).orderBy("pos")
    size = F.count(F.lit(1)).over(W.partitionBy(*by))
    conf = F.coalesce("conf", F.lit(1.0))
    fell = F.avg(conf).over(w.rowsBetween(-2, -1)) - F.avg(conf).over(w.rowsBetween(0, 2))
    seen = words.select(*by, "pos", size.alias("_size"), fell.alias("_fell")).where(F.col("_size") >= 4)
    signal = F.when(F.col("_fell") > drop, 1).when(F.col("_fell") <= drop * 0.5, 0)
    state = F.coalesce(F.last(signal, ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    turns = seen.withColumn("_s", state).withColumn("_b", F.coalesce(F.lag("_s").over(w), F.lit(0))).where("_s <> _b")
    length = F.coalesce(F.lead("pos").over(w), F.col("_size")) - F.col("pos")
    return turns.withColumn("_n", length).where((F.col("_s") == 1) & (F.col("_n") >= least)).select(*by, "pos")


def smooth_switches(words: DataFrame, switches: DataFrame, by: Sequence[str], reach: int = 3) -> DataFrame:
    """Words with times set evenly over the ``reach`` words on both sides of each switch: by, pos, t0, t1, smoothed.

    Times come from the words as given; where switches overlap the later one counts.
    """
    w = W.partitionBy(*by).orderBy("pos")
    first, last = W.partitionBy(*by, "_at").orderBy("pos"), W.partitionBy(*by, "_at")
    spread = switches.select(*by, F.col("pos").alias("_at"), F.explode(F.sequence(F.greatest(F.col("pos") - reach, F.lit(0)), F.col("pos") + reach)).alias("pos"))
    met = spread.join(words.select(*by, "pos", "t0", "t1"), [*by, "pos"])
    j, n = F.row_number().over(first) - 1, F.count(F.lit(1)).over(last)
    a, b = F.min_by("t0", "pos").over(last), F.max_by("t1", "pos").over(last)
    met = met.select(*by, "pos", "_at", j.alias("_j"), n.alias("_n"), a.alias("_a"), b.alias("_b")).where("_n > 1 AND _b > _a")
    share, whole = F.col("_j") / F.greatest(F.col("_n") - 1, F.lit(1)), (F.col("_b") - F.col("_a")) * 0.9
    new = met.select(*by, "pos", "_at", (F.col("_a") + share * whole).alias("_t0"), (F.col("_a") + (share + 1 / F.col("_n")) * whole).alias("_t1"))
    new = new.groupBy(*by, "pos").agg(F.max_by(F.struct("_t0", "_t1"), "_at").alias("_new"))
    out = words.join(new, [*by, "pos"], "left")
    return out.select(*by, "pos", F.coalesce("_new._t0", "t0").alias("t0"), F.coalesce("_new._t1", "t1").alias("t1"), F.col("_new").isNotNull().alias("smoothed"))


def edge_candidates(points: DataFrame, edges: DataFrame, by: Sequence[str], radius: float) -> DataFrame:
    """Each point (id, t) with the edges (at, label, source) of its key within ``radius``, and itself as label ``asr``.

    Edges meet points in buckets of ``radius`` seconds, three to a point. Equal candidate times are one, whose label is
    the first in order; ``sources`` counts the distinct sources of the edges at it.
    """
    bucket = lambda c: F.floor(F.col(c) / radius).cast("long")
    near = points.withColumn("_b", F.explode(F.array(*[bucket("t") + k for k in (-1, 0, 1)]))).join(edges.withColumn("_b", bucket("at")), [*by, "_b"]).where(F.abs(F.col("at") - F.col("t")) <= radius)
    own = points.select("id", *by, "t", F.col("t").alias("at"), F.lit("asr").alias("label"), F.lit("asr").alias("source"))
    both = near.select("id", *by, "t", "at", "label", "source").unionByName(own)
    return both.groupBy("id", *by, "t", "at").agg(F.min("label").alias("label"), F.count_distinct("source").alias("sources"))


def edge_score(asr: Column, **signals: Column) -> Column:
    """Weighted sum of the signals, each held in [0, 1]; a signal that is not given is 0, but vad 0.5."""
    unit = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
    given = {"asr": asr, "vad": F.lit(0.5)} | signals
    return sum((unit(F.coalesce(given[k], F.lit(0.0))) * w for k, w in SIGNALS.items() if k in given), F.lit(0.0))


def arbitrate(candidates: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of a point's candidates (at, label, score, rejected) the legal one that scores best: by, accepted, at, label, confidence, n_rejected.

    Ties go to the earlier time, then to the larger label. Without a legal candidate the point keeps its own time ``t``.
    """
    legal = F.col("rejected").isNull()
    order = F.when(legal, F.struct("score", -F.col("at"), F.col("label")))
    best = F.max_by(F.struct("at", "label", "score"), order)
    g = candidates.groupBy(*by).agg(F.any_value("t").alias("t"), F.max(legal).alias("accepted"), best.alias("_best"), F.count_if(~legal).alias("n_rejected"))
    at = F.when(F.col("accepted"), F.col("_best.at")).otherwise(F.col("t"))
    sure = F.when(F.col("accepted"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("_best.score")))).otherwise(0.0)
    return g.select(*by, "accepted", at.alias("at"), F.when(F.col("accepted"), F.col("_best.label")).alias("label"), sure.alias("confidence"), "n_rejected")


def nearest_of_direction(targets: DataFrame, candidates: DataFrame, by: Sequence[str], most: float = 0.5) -> DataFrame:
    """Each target (id, t, direction) with the nearest candidate (at, ord) of its direction within ``most``; ties go to the lower ``ord``."""
    b = lambda c: F.floor(F.col(c) / most).cast("long")
    met = targets.withColumn("_b", F.explode(F.array(*[b("t") + k for k in (-1, 0, 1)]))).join(candidates.withColumn("_b", b("at")), [*by, "direction", "_b"])
    best = met.where(F.abs(F.col("at") - F.col("t")) <= most).groupBy("id").agg(F.min(F.struct(F.abs(F.col("at") - F.col("t")).alias("away"), "ord", "at")).alias("_m"))
    return targets.join(best, "id", "left").select("id", *by, "direction", "t", F.col("_m.at").alias("at"))
