import random

import pytest

from spanloom.operators import assembly as A

WORDS = "m int, id string, text string, t0 double, t1 double, speaker int"
SPANS = "m int, id string, t0 double, t1 double"
EVIDENCE = "m int, id string, clip string, t0 double, t1 double"


def allocated(spark, words, clips, evidence=(), **more):
    kinds = {"bins": SPANS, "segments": "m int, n int, speaker int, words array<string>", "exclusive": "m int, speaker int, t0 double, t1 double", "turns": "m int, speaker int, t0 double, t1 double"}
    more = {k: spark.createDataFrame(v, kinds[k]) if k in kinds else v for k, v in more.items()}
    return A.allocate_words(spark.createDataFrame(words, WORDS), spark.createDataFrame(clips, SPANS), spark.createDataFrame(evidence, EVIDENCE), ["m"], 1.0, **more)


def test_words_over_a_clip_boundary_and_outside(spark):
    words = [(1, "a", "x", 0.8, 1.2, None), (1, "b", "x", 5.0, 5.2, None), (2, "a", "x", 0.8, 1.2, 4), (1, "c", "x", 2.0, 2.4, None)]
    got = {(r.m, r.id): r for r in allocated(spark, words, [(1, "p", 0.0, 1.0), (1, "q", 1.0, 2.2), (2, "p", 0.0, 3.0)], [(1, "e1", "p", 0.0, 0.9), (1, "e2", "q", 0.0, 3.0), (2, "e1", "q", 0.0, 3.0)]).collect()}
    one = got[1, "a"]
    assert one.accepted and one.warnings == ["cross_physical_boundary"] and [(s.clip, s.start, s.end, s.evidence) for s in one.spans] == [("p", 0.8, 1.0, ["e1"]), ("q", 1.0, 1.2, ["e2"])]
    assert not got[1, "b"].accepted and got[1, "b"].warnings == ["outside_physical_clip"] and got[1, "b"].spans == []
    assert got[2, "a"].speaker == 4 and got[2, "a"].warnings == ["missing_speech_evidence"] and got[1, "c"].spans[0].end == 2.2


def test_bins_and_strict_boundaries(spark):
    words = [(1, "a", "x", 2.0, 2.4, None), (1, "b", "x", 1.004, 1.2, None), (1, "c", "x", 0.9, 3.3, None)]
    clips = [(1, "p", 0.0, 1.5), (1, "q", 1.8, 4.0)]
    got = {r.id: r for r in allocated(spark, words, clips, bins=[(1, "b1", 0.0, 1.0)], strict=True).collect()}
    assert got["a"].warnings == ["outside_speech_bin"] and got["b"].accepted
    assert got["c"].warnings == ["cross_physical_boundary", "discontinuous_physical_boundary"] and not got["c"].accepted and got["c"].speaker_source == "unknown"
    counts = A.allocation_counts(allocated(spark, words, clips, bins=[(1, "b1", 0.0, 1.0)], strict=True), ["m"]).first()
    assert counts.asDict() == {"m": 1, "words": 3, "accepted": 1, "rejected": 2, "crossing": 1, "without_evidence": 1, "outside_bins": 1, "borrowed_speaker": 0}


def test_speakers_by_word_segment_and_turns(spark):
    words = [(1, i, "x", t, t + 0.2, s) for i, t, s in (("own", 0.0, 9), ("seg", 1.0, None), ("ex", 2.0, None), ("two", 3.0, None), ("turn", 4.0, None), ("both", 5.0, None), ("none", 6.0, None), ("bad", 7.0, None))]
    got = {
        r.id: (r.speaker, r.speaker_source, r.warnings)
        for r in allocated(
            spark, words, [(1, "p", 0.0, 9.0)], [(1, "e", "p", 0.0, 9.0)], segments=[(1, 0, 5, ["own", "seg"]), (1, 1, 7, ["seg"]), (1, 2, -1, ["bad"])],
            exclusive=[(1, 1, 2.0, 3.5), (1, 2, 3.0, 3.5)], turns=[(1, 3, 2.0, 5.5), (1, 4, 5.0, 5.5)],
        ).collect()
    }
    assert got == {
        "own": (9, "word", []), "seg": (7, "segment", []), "ex": (1, "exclusive_turn", []), "two": (None, "mixed", ["speaker_conflict"]), "turn": (3, "turn", []),
        "both": (None, "mixed", ["speaker_conflict"]), "none": (None, "unknown", []), "bad": (None, "unknown", []),
    }


def test_events_split_at_evidence_and_micro_events_join(spark):
    words = [(1, "w1", "no", 0.2, 0.5, 1), (1, "w2", "yes", 1.3, 1.6, 1)]
    clip = [(1, "p", 0.0, 2.0)]
    got = A.build_events(allocated(spark, words, clip, [(1, "e1", "p", 0.0, 0.7), (1, "e2", "p", 1.2, 2.0)]), ["m"]).orderBy("event").collect()
    assert [(r.event, r.t0, r.t1, r.text, r.split_before) for r in got] == [(1, 0.2, 0.5, "no", False), (2, 1.3, 1.6, "yes", True)]
    words = [(1, "w1", "好的", 0.2, 0.4, 1), (1, "w2", "吗", 0.4, 0.6, 1), (1, "w3", "later", 0.7, 0.9, 1)]
    bins = spark.createDataFrame([(1, "b1", 0.1, 0.45), (1, "b2", 0.5, 0.8)], SPANS)
    events = A.build_events(allocated(spark, words[:2], clip, [(1, "e", "p", 0.0, 2.0)]), ["m"], bins=bins)
    assert events.count() == 2
    (one,) = A.merge_micro_events(events, ["m"]).collect()
    assert one.text == "好的吗" and [w.id for w in one.words] == ["w1", "w2"] and (one.bin, one.bin0, one.bin1, one.event) == ("b1+b2", 0.1, 0.8, 1)


def groups(words, bins):
    """Groups of neighbours, and of bins, word by word."""
    def bin_of(w):
        met = [(min(w[4], b[3]) - max(w[3], b[2]), -abs((w[3] + w[4]) / 2 - (b[2] + b[3]) / 2), b[1]) for b in bins if b[0] == w[0]]
        met = [x for x in met if x[0] > 0]
        return max(met)[2] if met else None

    out = []
    for m in sorted({w[0] for w in words}):
        now, own = [], None
        for w in sorted((w for w in words if w[0] == m), key=lambda w: (w[3], w[4], w[1])):
            mine = bin_of(w)
            if now and not (w[5] == now[-1][5] and -0.01 <= w[3] - now[-1][4] <= 0.8):
                out.append(now)
                now = []
            if not now:
                own = mine
            elif mine is not None and own is not None and mine != own:
                out.append(now)
                now, own = [], mine
            now.append(w)
        out += [now] if now else []
    return [[w[1] for w in g] for g in out]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bin_events_against_a_loop(spark, seed):
    rng, words, bins = random.Random(seed), [], []
    for m in (1, 2):
        t = 0.0
        for i in range(120):
            t += rng.choice([0.0, 0.0, 0.1, 0.3, 1.0])
            words.append((m, f"w{i:03}", "x", round(t, 3), round(t + 0.25, 3), rng.choice([1, 1, 1, None])))
            t += 0.25
        at = 0.0
        while at < t:
            at += rng.choice([0.0, 0.4, 1.5])
            size = rng.uniform(0.4, 2.0)
            bins.append((m, f"b{len(bins):03}", round(at, 3), round(at + size, 3)))
            at += size
    a = allocated(spark, words, [(m, "p", 0.0, 1000.0) for m in (1, 2)])
    got = A.build_events(a, ["m"], bins=spark.createDataFrame(bins, SPANS)).orderBy("m", "event").collect()
    assert [[w.id for w in r.words] for r in got] == groups(words, bins)


def fragments(words, pause=0.35, long=0.6, most=15, seconds=8.0):
    out, now, heard, before = [], [], None, None
    for w in words:
        reason = None
        if before is not None and w["clip"] != before["clip"]:
            reason = "PhysicalClip"
        if heard is not None and w["speaker"] is not None and w["confirmed"] and w["speaker"] != heard:
            reason = "Speaker"
        gap = None if before is None else w["t0"] - before["t1"]
        if gap is not None and gap >= long:
            reason = "LongPause"
        if w["overlap"]:
            reason = "OverlapRegion"
        if reason and now:
            out.append(([x["id"] for x in now], reason))
            now = []
        now.append(w)
        soft = "max_words" if len(now) >= most else "max_duration" if w["t1"] - now[0]["t0"] >= seconds else "sentence_pause" if gap is not None and gap >= pause else None
        if soft:
            out.append(([x["id"] for x in now], soft))
            now = []
        if w["confirmed"] and w["speaker"] is not None:
            heard = w["speaker"]
        before = w
    return out + ([([x["id"] for x in now], "final")] if now else [])


@pytest.mark.parametrize("seed", [4, 5])
def test_fragments_against_a_loop(spark, seed):
    rng, t, words = random.Random(seed), 0.0, []
    for i in range(400):
        t += rng.choice([0.0] * 9 + [0.1, 0.2, 0.4, 0.9])
        length = rng.choice([0.1, 0.2, 1.5 if i > 200 else 0.3])
        words.append({"m": 1, "id": f"w{i:03}", "t0": round(t, 3), "t1": round(t + length, 3), "clip": f"c{i // 70}", "speaker": rng.choice([1] * 12 + [2, None]), "confirmed": rng.random() < 0.7, "overlap": rng.random() < 0.01, "language": "en"})
        t += length
    df = spark.createDataFrame(words, "m int, id string, t0 double, t1 double, clip string, speaker int, confirmed boolean, overlap boolean, language string").repartition(3)
    got = A.build_fragments(df, ["m"]).orderBy("fragment").collect()
    want = fragments(words)
    assert [(list(r.word_ids), r.reason) for r in got] == want and len({r for _, r in want}) >= 5
    assert [r.split_before for r in got] == [False] + [r not in ("max_words", "max_duration", "sentence_pause") for _, r in want[:-1]]


def test_no_words(spark):
    none = allocated(spark, [], [])
    assert none.count() == 0 and A.build_events(none, ["m"]).count() == 0
    assert A.merge_micro_events(A.build_events(none, ["m"]), ["m"]).count() == 0


def test_longest_turn(spark):
    points = spark.createDataFrame([(1, "a", 1.0), (1, "b", 9.0)], "m int, id string, t double")
    turns = spark.createDataFrame([(1, 1, 0.0, 2.0), (1, 2, 0.5, 4.0), (1, 3, 8.0, 9.0)], "m int, speaker int, t0 double, t1 double")
    assert [(r.id, r.speaker) for r in A.turn_at(points, turns, ["m"], 2.0).collect()] == [("a", 2)]


def test_slices_are_computed_once_and_sets_only_where_needed(spark):
    """A filter on lists that are never empty would compute the slices twice; events without bins need no windows of bins."""
    planned = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    turns = [(1, 1, 0.0, 2.0)]
    a = allocated(spark, [(1, "a", "x", 0.8, 1.2, None)], [(1, "p", 0.0, 1.0)], exclusive=turns, turns=turns)
    bins = spark.createDataFrame([(1, "b1", 0.0, 1.0)], SPANS)
    plain, binned = A.build_events(a, ["m"]), A.build_events(a, ["m"], bins=bins)
    assert planned(a).count("collect_set(") == 2
    assert planned(plain).count("Window [") < planned(binned).count("Window [")
    assert planned(A.merge_micro_events(binned, ["m"])).count("aggregate(items") == 1
