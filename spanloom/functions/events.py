"""Column expressions for events: coordinates, merge predicates, boundary choices, evidence checks and labels.

An event's ``spans`` are an array of structs (start, end, clip); warnings are a list joined by ``;``. Null means unknown.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Warnings that forbid a merge, openings and closings of sections, words that seldom end a sentence.
HARD_WARNINGS = ("physical_envelope_conflict", "discontinuous_physical_boundary", "speaker_conflict", "outside_physical_clip", "hard_split")
SECTION_OPENS = (
    r"^\d+[.)]\s", r"^(One|Two|Three|Four|Five|Six|Seven|Eight|Nine|Ten)[,.\s]", r"^[一二三四五六七八九十][、，.]", r"(?i)^Summary\s+(and|&)\s+review", r"(?i)^Example[:]?",
    r"(?i)^Effective\s+Communication", r"(?i)^(Phone\s+Etiquette|Rapid\s+Response)", r"(?i)^(Answer|Listen|Hang\s+up|Identify)", r"(?i)^End\s+with\s+courtesy",
)
SECTION_CLOSES = r"(?i)(^|\s)(and|with)\s+courtesy[.]?\s*$"
LOOSE_ENDS = (
    "very quite rather extremely unbearably really so too just only even almost nearly barely hardly scarcely completely totally absolutely especially particularly "
    "specifically actually basically literally definitely certainly probably possibly maybe perhaps and but or because if when that which who whom whose where while although "
    "though unless until since after before however therefore meanwhile furthermore moreover otherwise to for with without about against between through during also then now "
    "well okay right yeah yes no"
).split()
#: Days after which a parameter's evidence counts half (null: it keeps), and those of all others.
HALF_LIVES: Mapping[str, int | None] = {
    "subtitle.max_chars_cjk": 180, "subtitle.max_chars_latin": 180, "subtitle.max_duration": 180, "subtitle.min_duration": 180, "subtitle.max_lines": None,
    "merging.padding": 60, "merging.padding_max": 60, "merging.padding_min": 60, "merging.min_silence_gap": 60, "vad.threshold": 60, "vad.min_silence_duration_ms": 60,
    "noise_reduction.spectral_noise_reduction_db": 60, "noise_reduction.burst_noise_threshold_db": 60,
}
HALF_LIFE = 90


def to_global(t: Column, origin: Column) -> Column:
    return t + origin


def to_local(t: Column, origin: Column) -> Column:
    """Null before the origin."""
    return F.when(t >= origin, t - origin)


def clamped(start: Column, end: Column, duration: Column) -> Column:
    """struct<start, end> inside [0, duration]; null where nothing is left."""
    a, b = F.greatest(F.lit(0.0), F.least(start, duration)), F.greatest(F.lit(0.0), F.least(end, duration))
    return F.when((end > start) & (b > a), F.struct(a.alias("start"), b.alias("end")))


def to_sample(seconds: Column, rate: int = 16_000) -> Column:
    return (seconds * rate).cast("long")


def to_seconds(sample: Column, rate: int = 16_000) -> Column:
    return sample / F.lit(float(rate))


def shifted(spans: Column, offset: Column) -> Column:
    """An array of spans with start and end moved, whatever else they hold."""
    return F.transform(spans, lambda s: s.withField("start", s["start"] + offset).withField("end", s["end"] + offset))


def owners_agree(left: Column, right: Column, left_region: Column, right_region: Column, gap: float = 0.02) -> Column:
    """One region, a common clip, and spans that overlap or meet within ``gap``; two events without spans agree, one without does not."""
    both = F.array_sort(F.concat(left, right))
    n = F.size(both)
    clips = [F.filter(F.transform(x, lambda s: s["clip"]), lambda c: c.isNotNull()) for x in (left, right)]
    shared = (F.size(clips[0]) == 0) | (F.size(clips[1]) == 0) | F.arrays_overlap(*clips)
    ends, nexts = F.slice(both, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(both, F.lit(2), F.greatest(n - 1, F.lit(0)))
    meet = F.forall(F.zip_with(ends, nexts, lambda a, b: b["start"] - a["end"]), lambda d: d <= gap)
    none = (F.size(left) == 0).cast("int") + (F.size(right) == 0).cast("int")
    return left_region.eqNullSafe(right_region) & F.when(none == 2, True).when(none == 1, False).otherwise(shared & meet)


def owners_agree_loosely(left: Column, right: Column) -> Column:
    """A common clip, or one side without spans."""
    return (F.size(left) == 0) | (F.size(right) == 0) | F.arrays_overlap(F.transform(left, lambda s: s["clip"]), F.transform(right, lambda s: s["clip"]))


def warnings_agree(left: Column, right: Column, split_after: Column, split_before: Column) -> Column:
    """No hard split between them and no hard warning on either."""
    hard = F.array(*[F.lit(w) for w in HARD_WARNINGS])
    named = [F.coalesce(F.arrays_overlap(F.split(w, ";"), hard), F.lit(False)) for w in (left, right)]
    return ~(F.coalesce(split_after, F.lit(False)) | F.coalesce(split_before, F.lit(False)) | named[0] | named[1])


def may_merge(left: Column, right: Column, max_gap: float | None = None, max_duration: float | None = None) -> Column:
    """Merge rule for two event structs (speaker, start, end, spans, region, warnings, split_before, split_after)."""
    ok = left["speaker"].eqNullSafe(right["speaker"]) & warnings_agree(left["warnings"], right["warnings"], left["split_after"], right["split_before"])
    ok = ok & owners_agree(left["spans"], right["spans"], left["region"], right["region"], 0.02 if max_gap is None else max_gap)
    if max_gap is not None:
        ok = ok & (right["start"] - left["end"] <= max_gap)
    if max_duration is not None:
        ok = ok & (F.greatest(left["end"], right["end"]) - F.least(left["start"], right["start"]) <= max_duration)
    return ok


def section_break(text: Column, following: Column) -> Column:
    """Whether the next text opens a section or this one closes one."""
    opens = F.lit(False)
    for pattern in SECTION_OPENS:
        opens = opens | F.trim(following).rlike(pattern)
    return opens | F.trim(text).rlike(SECTION_CLOSES)


def doubtful_stop(text: Column) -> Column:
    """A final stop after five words or more whose last word seldom ends a sentence."""
    bare = F.rtrim(text)
    last = F.regexp_replace(F.lower(F.regexp_extract(bare, r"(\S+)$", 1)), r"[.!?。！？,，;；:：]+$", "")
    return F.coalesce((F.length(bare) >= 2) & bare.rlike(r"[.!?。！？]$") & (F.size(F.split(F.trim(bare), r"\s+")) >= 5) & last.isin(*LOOSE_ENDS), F.lit(False))


def has_word_evidence(words: Column, least: float = 0.35) -> Column:
    """Whether a word (text, start, end, confidence) has a text, a length and confidence."""
    return F.coalesce(F.exists(words, lambda w: (F.trim(w["text"]) != "") & (w["end"] > w["start"]) & (w["confidence"] >= least)), F.lit(False))


def edge_confidence(words: Column, last: bool) -> Column:
    """Confidence of the word at an event's edge, in [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_element_at(words, F.lit(-1 if last else 1))["confidence"]))


def keeps_edge(words: Column, last: bool, least: float) -> Column:
    return F.coalesce(edge_confidence(words, last) >= least, F.lit(False))


def evidence_fault(start: Column, end: Column, offset: Column, duration: Column) -> Column:
    """Why a detected range is not taken; null if it is."""
    return (
        F.when(start.isNull() | end.isNull(), "missing").when((start < 0) | (end <= start), "range").when((start + offset < 0) | (end + offset > duration), "timeline")
    )


def overlaps_request(start: Column, end: Column, left: Column, right: Column, epsilon: float = 0.01) -> Column:
    return (end > left + epsilon) & (start < right - epsilon)


def tier(confidence: Column) -> Column:
    return F.when(confidence.isNull(), "unknown").when(confidence >= 0.9, "high").when(confidence >= 0.6, "medium").otherwise("low")


def tier_window(name: Column) -> Column:
    """Seconds around a word in which its edge is looked for."""
    return F.when(name == "high", 0.2).when(name == "medium", 0.3).otherwise(0.5)


def chosen_edge(refined: Column, ratio: Column, physical: Column, silent: Column, original: Column) -> Column:
    """A clear energy step keeps the refined time, silence takes the physical one, else the smaller correction wins."""
    nearer = F.abs(refined - original) <= F.abs(physical - original)
    return F.when(ratio > 5, refined).when(silent, physical).when(nearer, refined).otherwise(physical)


def speech_overlap_ms(words: Column, seconds: Column) -> Column:
    """Window overlap by the rate of speech."""
    rate = words / seconds
    return F.when((words == 0) | (seconds <= 0), 500).when(rate > 5, 1000).when(rate > 4, 750).otherwise(500)


def half_life(path: Column) -> Column:
    """Days of a parameter's half life; null: it keeps its weight."""
    out = F.lit(HALF_LIFE)
    for name, days in HALF_LIVES.items():
        out = F.when(path == name, F.lit(days).cast("int")).otherwise(out)
    return out


def effective_weight(age_days: Column, path: Column) -> Column:
    days = half_life(path)
    return F.when(days.isNull(), 1.0).otherwise(F.pow(F.lit(0.5), F.greatest(F.lit(0.0), age_days) / days))


def rolls_back(before: Column, after: Column, drop: float = 0.3) -> Column:
    return F.when(before > 0, (after - before) / before <= -drop).otherwise(False)


def surge(before: Column, after: Column, times: float = 2.5) -> Column:
    """Confidence of a change of loudness from its mean squares' roots: weak at best, as loudness alone is no boundary."""
    ratio = after / before
    return F.when(before < 1e-10, F.when(after > 1e-8, 0.15).otherwise(0.0)).when(ratio >= times, F.round(F.least(F.lit(0.4), (ratio - times) / (3 * times)), 3)).otherwise(0.0)


def labelled(text: Column, label: Column, style: str) -> Column:
    """``bracket``: [label] text, ``prefix``: label: text; without a label the text alone."""
    shown = {"bracket": F.concat(F.lit("["), label, F.lit("] "), text), "prefix": F.concat(label, F.lit(": "), text)}.get(style, text)
    return F.when(F.coalesce(label, F.lit("")) == "", text).otherwise(shown)


def unlabelled(text: Column) -> Column:
    return F.regexp_replace(text, r"^\[Speaker [^\]]+\]\s*", "")


def cjk_share(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}]")) / F.greatest(F.lit(1), F.length(F.replace(text, F.lit(" "))))


def mainly_cjk(text: Column, share: float = 0.5) -> Column:
    return cjk_share(text) > share


def room(text: Column, lines: int = 2, cjk: int = 20, latin: int = 42) -> Column:
    """Characters that a cue of this script may have."""
    return F.when(mainly_cjk(text), cjk * lines).otherwise(latin * lines)


def bare(text: Column) -> Column:
    """A text without case, white space, punctuation and symbols, for comparison."""
    return F.regexp_replace(F.lower(text), r"[\s\p{P}\p{Sm}\p{Sc}\p{Sk}\p{So}]", "")


def fenced_json(text: Column) -> Column:
    """The JSON part of an answer: in its first fence, else from the first brace to the last."""
    fence = F.regexp_extract(text, r"(?s)```(?:json)?(.*?)```", 1)
    return F.when(text.contains("```"), F.trim(F.regexp_replace(fence, r"^\s+|\s+$", ""))).otherwise(F.regexp_extract(text, r"(?s)(\{.*\})", 1))


def covariance_similarity(distance: Column, dims: int) -> Column:
    return F.exp(-distance / F.sqrt(F.lit(float(dims))))
