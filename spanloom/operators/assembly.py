"""From timed words to events: words to clips, evidence and speakers, then to events, to events of bins, and to fragments.

Words have an ``id`` that is theirs alone within the keys ``by``. What only looks at neighbours is a window; what depends on what a group
has become is a fold over the words or events of one island, which no rule can leave.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.text import join_tokens
from . import intervals as iv
from .cues import _let

ORDER = ("t0", "t1", "id")
T_SPANS = "array<struct<start:double,end:double,clip:string,evidence:array<string>>>"


def _in_order(by: Sequence[str]):
    return W.partitionBy(*by).orderBy(*ORDER)


def _texts(*values: str) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def turn_at(points: DataFrame, turns: DataFrame, by: Sequence[str], width: float) -> DataFrame:
    """(by, id, speaker): who holds the longest turn that contains each point (id, t); of equally long ones the earliest."""
    met = iv.stab_join(points, turns.select(*by, "speaker", "t0", "t1"), by, width).where("t < r_t1")
    return met.groupBy(*by, "id").agg(F.max_by("r_speaker", F.struct(F.col("r_t1") - F.col("r_t0"), -F.col("r_t0"), "r_speaker")).alias("speaker"))


def _speakers(words: DataFrame, by: Sequence[str], width: float, segments: DataFrame | None, exclusive: DataFrame | None, turns: DataFrame | None) -> DataFrame:
    """``words`` with ``said``: struct<speaker, source, conflict> by the word itself, its segment, exclusive turns or any turns at its middle, in this order."""
    key, word = [*by, "id"], F.col("speaker")
    if segments is None:
        words = words.withColumn("_segment", word.cast(words.schema["speaker"].dataType))
    else:
        # of several segments that name a word the last one counts
        named = segments.select(*by, "n", F.when(F.col("speaker") >= 0, F.col("speaker")).alias("_s"), F.explode("words").alias("id"))
        words = words.join(named.groupBy(*key).agg(F.max_by("_s", "n").alias("_segment")), key, "left")
    layers = [t.select(*by, F.lit(k).alias("layer"), "speaker", "t0", "t1") for k, t in enumerate((exclusive, turns)) if t is not None]
    if layers:
        every = layers[0] if len(layers) == 1 else layers[0].unionByName(layers[1])
        open_ = words.where(word.isNull() & F.col("_segment").isNull()).select(*by, "id", ((F.col("t0") + F.col("t1")) / 2).alias("t"))
        met = iv.stab_join(open_, every, by, width).where("t < r_t1")
        # the least and the largest speaker tell none, one and several apart, and need no sets, which Spark sorts for
        found = lambda k: F.when(F.col("r_layer") == k, F.col("r_speaker"))
        heard = met.groupBy(*key).agg(*[f(found(k)).alias(f"_h{k}{n}") for k in (0, 1) for n, f in (("a", F.min), ("z", F.max))])
        words = words.join(heard, key, "left")
    else:
        words = words.withColumns({f"_h{k}{n}": F.lit(None).cast("int") for k in (0, 1) for n in "az"})
    nobody = F.lit(None).cast("int")
    said = lambda who, source, conflict=False: F.struct(who.cast("int").alias("speaker"), F.lit(source).alias("source"), F.lit(conflict).alias("conflict"))
    out = F.when(word.isNotNull(), said(word, "word")).when(F.col("_segment").isNotNull(), said(F.col("_segment"), "segment"))
    for k, source in ((0, "exclusive_turn"), (1, "turn")):
        out = out.when(F.col(f"_h{k}a") == F.col(f"_h{k}z"), said(F.col(f"_h{k}a"), source)).when(F.col(f"_h{k}a") < F.col(f"_h{k}z"), said(nobody, "mixed", True))
    return words.withColumn("said", out.otherwise(said(nobody, "unknown"))).drop("_segment", "_h0a", "_h0z", "_h1a", "_h1z")


def allocate_words(
    words: DataFrame, clips: DataFrame, evidence: DataFrame, by: Sequence[str], width: float, *, bins: DataFrame | None = None, segments: DataFrame | None = None,
    exclusive: DataFrame | None = None, turns: DataFrame | None = None, epsilon: float = 0.005, strict: bool = False,
) -> DataFrame:
    """``words`` (id, t0, t1, speaker) with the clips they lie in, the evidence there, a speaker, and whether they are accepted.

    Adds ``spans`` (start, end, clip, evidence ids: the word cut to each clip), ``evidence`` (start, end, id, clip), ``speaker_source``,
    ``warnings`` and ``accepted``; ``speaker`` is resolved. A word is rejected outside all clips, outside all ``bins`` (t0, t1; widened by
    ``epsilon``) if they are given, and, if ``strict``, where its clips do not meet. ``clips`` have (id, t0, t1), ``evidence`` (id, clip, t0, t1),
    ``segments`` (n, speaker, words), ``exclusive`` and ``turns`` (speaker, t0, t1).
    """
    key = [*by, "id"]
    met = iv.overlap_join(words.select(*key, "t0", "t1"), clips.select(*key, "t0", "t1"), by, width)
    met = met.select(*key, F.col("r_id").alias("clip"), F.greatest("t0", "r_t0").alias("t0"), F.least("t1", "r_t1").alias("t1")).where("t1 > t0")
    heard = iv._bucketed(evidence.select(*by, "clip", "id", "t0", "t1"), width).select(*by, "clip", "_b", F.col("id").alias("e_id"), F.col("t0").alias("e0"), F.col("t1").alias("e1"))
    left = iv._bucketed(met, width).drop("_first").alias("l")
    on = [F.col(f"l.{c}") == F.col(f"e.{c}") for c in [*by, "clip", "_b"]] + [F.col("e.e0") < F.col("l.t1"), F.col("e.e1") > F.col("l.t0")]
    both = left.join(heard.alias("e"), on, "left")
    span = F.struct(F.col("l.t0").alias("start"), F.col("l.t1").alias("end"), F.col("l.clip").alias("clip"))
    piece = F.when(F.col("e_id").isNotNull(), F.struct(F.col("e0").alias("start"), F.col("e1").alias("end"), F.col("e_id").alias("id"), F.col("l.clip").alias("clip")))
    # a span and its evidence may meet in several buckets
    lists = both.groupBy(*[F.col(f"l.{k}").alias(k) for k in key]).agg(F.array_sort(F.collect_set(span)).alias("_spans"), F.array_sort(F.collect_set(piece)).alias("_evidence"))
    out = _speakers(words, by, width, segments, exclusive, turns).join(lists, key, "left")
    if bins is None:
        out = out.withColumn("_in", F.lit(True))
    else:
        wide = bins.select(*by, (F.col("t0") - epsilon).alias("t0"), (F.col("t1") + epsilon).alias("t1"))
        inside = iv.overlap_join(words.select(*key, "t0", "t1"), wide, by, width).select(*key).distinct().withColumn("_in", F.lit(True))
        out = out.join(inside, key, "left")
    pieces = F.coalesce("_evidence", F.array().cast(lists.schema["_evidence"].dataType))
    owned = F.transform("_spans", lambda s: F.struct(s["start"], s["end"], s["clip"], F.transform(F.filter(pieces, lambda e: e["clip"] == s["clip"]), lambda e: e["id"]).alias("evidence")))
    n = F.coalesce(F.size("_spans"), F.lit(0))
    follow = F.slice("_spans", F.lit(2), F.greatest(n - 1, F.lit(0)))
    apart = F.exists(F.zip_with(F.slice("_spans", F.lit(1), F.greatest(n - 1, F.lit(0))), follow, lambda a, b: b["start"] - a["end"]), lambda gap: gap > epsilon)
    crossing, missing, conflict = n > 1, F.size(pieces) == 0, F.col("said.conflict")
    names = lambda *pairs: F.filter(F.array(*[F.when(c, F.lit(v)) for c, v in pairs]), lambda x: x.isNotNull())
    refused = F.when(n == 0, _texts("outside_physical_clip")).when(F.col("_in").isNull(), _texts("outside_speech_bin"))
    if strict:
        refused = refused.when(crossing & apart, _texts("cross_physical_boundary", "discontinuous_physical_boundary"))
    warned = names((crossing, "cross_physical_boundary"), (missing, "missing_speech_evidence"), (conflict, "speaker_conflict"))
    return out.withColumn("_no", refused).select(
        *[c for c in words.columns if c != "speaker"], F.coalesce(owned, F.array().cast(T_SPANS)).cast(T_SPANS).alias("spans"), pieces.alias("evidence"),
        F.when(F.col("_no").isNull(), F.col("said.speaker")).alias("speaker"), F.when(F.col("_no").isNull(), F.col("said.source")).otherwise("unknown").alias("speaker_source"),
        F.coalesce("_no", warned).alias("warnings"), F.col("_no").isNull().alias("accepted"),
    )


def allocation_counts(allocated: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per ``by``: words, accepted, rejected, crossing, without evidence, outside bins, and accepted ones whose speaker is not their own."""
    has = lambda w: F.array_contains("warnings", w)
    borrowed = F.col("accepted") & ~F.col("speaker_source").isin("word", "unknown")
    return allocated.groupBy(*by).agg(
        F.count(F.lit(1)).alias("words"), F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("rejected"), F.count_if(has("cross_physical_boundary")).alias("crossing"),
        F.count_if(has("missing_speech_evidence")).alias("without_evidence"), F.count_if(has("outside_speech_bin")).alias("outside_bins"), F.count_if(borrowed).alias("borrowed_speaker"),
    )


def _touch(left: Column, right: Column, most: float, close: float = 0.01) -> Column:
    """Two lists of spans follow each other within ``most`` and share a clip, or all of both meet within ``close``."""
    both = F.array_sort(F.transform(F.concat(left, right), lambda s: F.struct(s["start"], s["end"])))
    n = F.size(both)
    gaps = F.zip_with(F.slice(both, F.lit(1), n - 1), F.slice(both, F.lit(2), n - 1), lambda a, b: b["start"] - a["end"])
    clips = [F.transform(x, lambda s: s["clip"]) for x in (left, right)]
    ahead = F.array_min(F.transform(right, lambda s: s["start"])) - F.array_max(F.transform(left, lambda s: s["end"]))
    return (F.size(left) > 0) & (F.size(right) > 0) & (ahead <= most) & (F.arrays_overlap(*clips) | F.forall(gaps, lambda d: d <= close))


def follows(by: Sequence[str], max_gap: float = 0.8, max_evidence_gap: float = 0.35) -> Column:
    """Whether an accepted word belongs to the group of the word before it, as far as the two decide."""
    w = _in_order(by)
    before = {c: F.lag(c).over(w) for c in ("t1", "speaker", "speaker_source", "spans", "evidence")}
    gap = F.col("t0") - before["t1"]
    run = F.array_min(F.transform("evidence", lambda e: e["start"])) - F.array_max(F.transform(before["evidence"], lambda e: e["end"]))
    known = (F.size("evidence") == 0) | (F.size(before["evidence"]) == 0) | (run <= max_evidence_gap)
    one = F.col("speaker").eqNullSafe(before["speaker"]) & (F.col("speaker_source") != "mixed") & (before["speaker_source"] != "mixed")
    return F.coalesce(one & (gap >= -0.01) & (gap <= max_gap) & known & _touch(before["spans"], F.col("spans"), max_gap), F.lit(False))


def best_bins(words: DataFrame, bins: DataFrame, by: Sequence[str], width: float) -> DataFrame:
    """(by, id, bin): struct<id, start, end> of the bin that a word overlaps most; ties to the nearer middle, then the larger id."""
    met = iv.overlap_join(words.select(*by, "id", "t0", "t1"), bins.select(*by, "id", "t0", "t1"), by, width).where(iv.overlap_seconds() > 0)
    away = F.abs((F.col("t0") + F.col("t1")) / 2 - (F.col("r_t0") + F.col("r_t1")) / 2)
    bin_ = F.struct(F.col("r_id").alias("id"), F.col("r_t0").alias("start"), F.col("r_t1").alias("end"))
    return met.groupBy(*by, "id").agg(F.max_by(bin_, F.struct(iv.overlap_seconds(), -away, "r_id")).alias("bin"))


def _merged_spans(spans: Column, close: float = 0.005) -> Column:
    """Spans of one clip and the same evidence coalesced within ``close``, by place."""
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["clip"], s["evidence"], s["start"], s["end"])))
    none = F.array().cast("array<struct<clip:string,evidence:array<string>,start:double,end:double>>")

    def step(out: Column, s: Column) -> Column:
        last = F.element_at(out, -1)
        joins = (F.size(out) > 0) & (last["clip"] == s["clip"]) & (last["evidence"] == s["evidence"]) & (s["start"] <= last["end"] + close)
        longer = F.struct(s["clip"], s["evidence"], last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))
        return F.when(joins, F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(longer))).otherwise(F.concat(out, F.array(s)))

    folded = F.aggregate(order, none, lambda out, s: F.when(F.size(out) == 0, F.array(s)).otherwise(step(out, s)))
    return F.array_sort(F.transform(folded, lambda s: F.struct(s["start"], s["end"], s["clip"], s["evidence"])))


def build_events(words: DataFrame, by: Sequence[str], max_gap: float = 0.8, max_evidence_gap: float = 0.35, bins: DataFrame | None = None, width: float = 1.0) -> DataFrame:
    """Events of the accepted words of ``allocate_words`` (with ``text``), numbered from 1 by place.

    Without ``bins`` (id, t0, t1) a group ends where the next word does not follow. With them it also ends where a word's bin differs from
    the one that the group began with; a group that began outside all bins is never cut by them, and an event has the bounds of its bin if it is
    the bin's only group. Optional columns: ``aligned0``, ``aligned1`` (times that replace the first and last word's), ``start_ok``, ``end_ok``
    (whether a boundary decision was accepted; else the timing counts as degraded).
    """
    for name, kind in (("aligned0", "double"), ("aligned1", "double"), ("start_ok", "boolean"), ("end_ok", "boolean")):
        if name not in words.columns:
            words = words.withColumn(name, F.lit(None).cast(kind))
    words = words.where("accepted")
    none = F.lit(None).cast("struct<id:string,start:double,end:double>")
    held = words.withColumn("bin", none) if bins is None else words.join(best_bins(words, bins, by, width), [*by, "id"], "left")
    w = _in_order(by)
    held = held.withColumn("_new", (~follows(by, max_gap, max_evidence_gap)).cast("int")).withColumn("_run", F.sum("_new").over(w))
    if bins is None:
        held = held.withColumn("_part", F.lit(0).cast("long"))
    else:
        inner = W.partitionBy(*by, "_run").orderBy(*ORDER)
        # inside a run the group's bin is the last one seen, as any other one has begun a group; a run that begins without one has none
        began, last = F.first("bin.id").over(inner), F.last("bin.id", ignorenulls=True).over(inner.rowsBetween(W.unboundedPreceding, -1))
        held = held.withColumn("_cut", F.coalesce((F.col("bin.id") != last) & began.isNotNull(), F.lit(False)).cast("int")).withColumn("_part", F.sum("_cut").over(inner))
    group = ["_run", "_part"]
    fields = [*ORDER, "text", "speaker", "speaker_source", "spans", "evidence", "warnings", "aligned0", "aligned1", "start_ok", "end_ok", "bin"]
    items, i0, i1 = F.col("items"), F.col("items")[0], F.element_at("items", -1)
    grouped = held.groupBy(*by, *group).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("items"))

    def proved(i: Column) -> Column:
        inside = F.transform(i["evidence"], lambda e: F.struct(F.greatest(i["t0"], e["start"]).alias("start"), F.least(i["t1"], e["end"]).alias("end"), e["clip"].alias("clip"), F.array(e["id"]).alias("evidence")))
        return F.filter(inside, lambda s: s["start"] < s["end"])

    plain = F.flatten(F.transform(items, lambda i: i["spans"]))
    proof = _let(F.flatten(F.transform(items, proved)), lambda evidence: F.when(F.size(evidence) > 0, evidence).otherwise(plain))
    fine = F.coalesce(i0["start_ok"] & i1["end_ok"], F.lit(False))
    warnings = F.array_distinct(F.concat(F.flatten(F.transform(items, lambda i: i["warnings"])), F.when(fine, _texts()).otherwise(_texts("timing_degraded"))))
    status = F.when(i0["speaker"].isNotNull(), "known").when(F.exists(items, lambda i: i["speaker_source"] == "mixed"), "mixed").otherwise("unknown")
    numbered = grouped.withColumn("event", F.row_number().over(W.partitionBy(*by).orderBy(*group))).withColumn("_alone", F.count(F.lit(1)).over(W.partitionBy(*by, i0["bin"]["id"])) == 1)
    own = F.when(F.col("_alone"), i0["bin"])
    return numbered.select(
        *by, "event", F.coalesce(i0["aligned0"], i0["t0"]).alias("t0"), F.coalesce(i1["aligned1"], i1["t1"]).alias("t1"), join_tokens(F.transform(items, lambda i: i["text"])).alias("text"),
        F.transform(items, lambda i: F.struct(i["id"], i["text"], i["t0"], i["t1"])).alias("words"), i0["speaker"].alias("speaker"), status.alias("speaker_status"), i0["speaker_source"].alias("speaker_source"),
        _merged_spans(proof).alias("spans"), warnings.alias("warnings"), (F.col("event") > 1).alias("split_before"),
        own["id"].alias("bin"), own["start"].alias("bin0"), own["end"].alias("bin1"), F.when(fine, "boundary_decision").otherwise("timing_degraded").alias("time_source"),
    )


def _parts(items: Column, state: Column, add, ends) -> Column:
    """Consecutive slices of an array, as struct<first, n>: a slice ends after an item where ``ends(state, item)`` holds of the state with the item added.

    ``add(state, item)`` gives the state of a slice with one more item, ``state`` that of none. Take the slices of lists that are not empty by
    ``explode_outer``: Spark would compute those of ``explode`` twice, to filter out empty lists first.
    """
    piece = lambda first, n: F.struct(first.alias("first"), n.alias("n"))
    acc = lambda out, first, n, s: F.struct(out.alias("out"), first.alias("first"), n.alias("n"), s.alias("s"))
    start = acc(F.array().cast("array<struct<first:int,n:int>>"), F.lit(1), F.lit(0), state)

    def step(a: Column, item: Column) -> Column:
        s, n = add(a["s"], item), a["n"] + 1
        return F.when(ends(s, item), acc(F.concat(a["out"], F.array(piece(a["first"], n))), a["first"] + n, F.lit(0), state)).otherwise(acc(a["out"], a["first"], n, s))

    return F.aggregate(items, start, step, lambda a: F.when(a["n"] > 0, F.concat(a["out"], F.array(piece(a["first"], a["n"])))).otherwise(a["out"]))


def merge_micro_events(events: DataFrame, by: Sequence[str], max_bin_gap: float = 0.15, max_word_gap: float = 0.05, max_chars: int = 2) -> DataFrame:
    """Events of ``build_events`` of ``max_chars`` characters or fewer joined to the neighbour they touch, numbered anew.

    Two events join if one is that short (what has been joined before counts as one), they share their only clip and the speaker, neither has a hard
    warning, the first does not end a sentence, their bins are ``max_bin_gap`` apart at most and their words follow within ``max_word_gap``.
    """
    w = W.partitionBy(*by).orderBy("event")
    before = lambda c: F.lag(c).over(w)
    clips = F.array_distinct(F.transform("spans", lambda s: s["clip"]))
    only = F.when(F.size(clips) == 1, clips[0])
    hard = F.arrays_overlap("warnings", _texts("speaker_conflict", "discontinuous_physical_boundary"))
    seen = events.withColumn("_clip", only).withColumn("_hard", hard).withColumn("_chars", F.length(F.replace("text", F.lit(" "), F.lit(""))))
    last = F.element_at(before("words"), -1)
    gap, step = F.col("bin0") - before("bin1"), F.col("words")[0]["t0"] - last["t1"]
    joins = (F.col("_clip") == before("_clip")) & F.col("speaker").eqNullSafe(before("speaker")) & ~F.col("_hard") & ~before("_hard") & ~F.trim(last["text"]).rlike("[.!?。！？]$")
    joins = F.coalesce(joins & (gap >= 0) & (gap <= max_bin_gap) & (step >= -0.01) & (step <= max_word_gap), F.lit(False))
    chained = seen.withColumn("_chain", F.sum((~joins).cast("int")).over(w)).withColumn("_next", F.lead("_chars").over(w))
    fields = [c for c in events.columns if c not in by and c != "event"]
    chains = chained.groupBy(*by, "_chain").agg(F.sort_array(F.collect_list(F.struct("event", "_chars", "_next", *fields))).alias("items"))
    # a part ends before an event unless that event or the part is short
    parts = _parts(F.col("items"), F.lit(0), lambda s, i: s + i["_chars"], lambda s, i: F.least(s, F.coalesce(i["_next"], F.lit(0))) > max_chars)
    pieces = chains.withColumn("_p", F.explode_outer(parts)).withColumn("items", F.slice("items", F.col("_p.first"), F.col("_p.n")))
    items, i0, i1 = F.col("items"), F.col("items")[0], F.element_at("items", -1)
    words = F.flatten(F.transform(items, lambda i: i["words"]))
    bins = F.concat_ws("+", F.filter(F.transform(items, lambda i: i["bin"]), lambda b: b.isNotNull()))
    changed = {
        "t1": i1["t1"], "text": join_tokens(F.transform(words, lambda x: x["text"])), "words": words, "spans": F.when(F.size(items) > 1, _merged_spans(F.flatten(F.transform(items, lambda i: i["spans"])))).otherwise(i0["spans"]),
        "bin": F.when(bins != "", bins), "bin1": i1["bin1"], "warnings": F.array_distinct(F.flatten(F.transform(items, lambda i: i["warnings"]))),
    }
    rank = F.row_number().over(W.partitionBy(*by).orderBy("_at"))
    out = pieces.select(*by, i0["event"].alias("_at"), *[changed.get(c, i0[c]).alias(c) for c in fields]).withColumn("event", rank)
    return out.select(*events.columns)


def build_fragments(words: DataFrame, by: Sequence[str], long_pause: float = 0.6, pause: float = 0.35, max_words: int = 15, max_seconds: float = 8.0, by_speaker: bool = True) -> DataFrame:
    """Runs of ``words`` (id, t0, t1, clip, speaker, confirmed, overlap, language) between hard and soft breaks, numbered from 1 by place.

    A fragment ends before a word that changes the clip, or the confirmed speaker, comes after ``long_pause`` or lies in an overlap (hard; of several
    reasons the last named counts), and after a word that makes it ``max_words`` or ``max_seconds`` long or comes after ``pause`` (soft).
    """
    w = _in_order(by)
    confirmed = F.coalesce("confirmed", F.lit(False))
    heard = F.last(F.when(confirmed, F.col("speaker")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1))
    gap = F.col("t0") - F.lag("t1").over(w)
    reasons = [("OverlapRegion", F.col("overlap")), ("LongPause", gap >= long_pause)]
    reasons += [("Speaker", confirmed & (F.col("speaker") != heard))] if by_speaker else []
    hard = F.lit(None).cast("string")
    for name, test in reversed([*reasons, ("PhysicalClip", F.col("clip") != F.lag("clip").over(w))]):
        hard = F.when(test, name).otherwise(hard)
    seen = words.withColumn("_hard", hard).withColumn("_gap", gap).withColumn("_soft", F.coalesce(gap >= pause, F.lit(False)))
    seen = seen.withColumn("_next", F.lead("_hard").over(w)).withColumn("_new", (F.col("_hard").isNotNull() | F.coalesce(F.lag("_soft").over(w), F.lit(False))).cast("int"))
    fields = [*ORDER, "speaker", "confirmed", "language", "_gap", "_soft", "_next"]
    islands = seen.withColumn("_island", F.sum("_new").over(w)).groupBy(*by, "_island").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("items"))
    none = F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("from"))
    full = lambda s, i: (s["n"] >= max_words) | (i["t1"] - s["from"] >= max_seconds)
    parts = _parts(F.col("items"), none, lambda s, i: F.struct((s["n"] + 1).alias("n"), F.coalesce(s["from"], i["t0"]).alias("from")), full)
    pieces = islands.withColumn("_p", F.explode_outer(parts)).withColumn("items", F.slice("items", F.col("_p.first"), F.col("_p.n")))
    items, i0, i1 = F.col("items"), F.col("items")[0], F.element_at("items", -1)
    soft = F.when(F.size(items) >= max_words, "max_words").when(i1["t1"] - i0["t0"] >= max_seconds, "max_duration").when(i1["_soft"], "sentence_pause")
    who = F.filter(F.transform(items, lambda i: i["speaker"]), lambda s: s.isNotNull())
    out = pieces.select(
        *by, F.transform(items, lambda i: i["id"]).alias("word_ids"), i0["t0"].alias("t0"), i1["t1"].alias("t1"), F.get(who, F.lit(0)).alias("speaker"), F.coalesce(i0["confirmed"], F.lit(False)).alias("confirmed"),
        i0["language"].alias("language"), F.coalesce(soft, i1["_next"], F.lit("final")).alias("reason"), F.when(soft.isNotNull(), "sentence").when(i1["_next"].isNotNull(), "hard_split").otherwise("").alias("pause_class"),
        F.when(soft.isNotNull(), F.coalesce(i1["_gap"], F.lit(0.0))).otherwise(0.0).alias("pause"), F.struct(*[i0[c] for c in ORDER]).alias("_at"),
    )
    place = W.partitionBy(*by).orderBy("_at")
    return out.withColumn("fragment", F.row_number().over(place)).withColumn("split_before", F.coalesce(F.lag("pause_class").over(place) == "hard_split", F.lit(False))).drop("_at")
