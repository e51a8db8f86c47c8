import random

from spanloom.operators import projection as P
from spanloom.operators import union as U

WORDS = "m int, id string, t0 double, t1 double, text string, confidence double, language string"


def by_loop(words):
    kept, alias = [], {}
    for w in sorted(words, key=lambda w: (w[2], w[3], w[1])):
        def same(k, w=w):
            lap, short = min(k[3], w[3]) - max(k[2], w[2]), min(k[3] - k[2], w[3] - w[2])
            a, b = (k[6] or "").lower(), (w[6] or "").lower()
            return "".join(k[4].split()).lower() == "".join(w[4].split()).lower() and lap >= -0.08 and lap >= short * 0.5 - 0.08 and (not a or not b or a == b)

        old = next((k for k in kept if same(k)), None)
        rank = lambda x: (x[5] or 0.0, x[3] - x[2], -len(x[1]))
        if old is None:
            kept.append(w)
        elif rank(w) > rank(old):
            kept.remove(old)
            kept.append(w)
            alias = {k: w[1] if v == old[1] else v for k, v in alias.items()} | {old[1]: w[1]}
        else:
            alias[w[1]] = old[1]
    return {k[1] for k in kept}, alias


def test_union_against_a_loop(spark):
    rng, words = random.Random(8), []
    for i in range(600):
        t = round(rng.uniform(0, 40), 2)
        words.append((1, f"w{i}", t, round(t + rng.choice([0.1, 0.3, 0.8]), 2), rng.choice(["a b", "AB", "c", "d"]), rng.choice([0.2, 0.5, 0.9, None]), rng.choice(["en", "EN", "de", None])))
    df = spark.createDataFrame(words, WORDS)
    kept, aliases = U.union_words(df.repartition(4), ["m"])
    want, named = by_loop(words)
    got = {r.id: r.canonical for r in aliases.collect()}
    assert {r.id for r in kept.collect()} == want and got == named
    # no alias points to a word that is gone, and every word has one fate
    assert set(got.values()) <= want and not want & set(got) and len(want) + len(got) == 600 and len(got) > 100


def test_window_words_and_segments(spark):
    words = [(1, "a1", 0.4, 0.7, "hi", 0.9, None), (1, "b1", 0.42, 0.7, "hi", 0.5, "en"), (1, "b2", 0.8, 1.0, "you", 0.5, "en"), (2, "a1", 0.4, 0.7, "hi", 0.1, None)]
    kept, aliases = U.union_words(spark.createDataFrame(words, WORDS), ["m"])
    assert sorted((r.m, r.id) for r in kept.collect()) == [(1, "a1"), (1, "b2"), (2, "a1")] and [tuple(r) for r in aliases.collect()] == [(1, "b1", "a1")]
    segments = spark.createDataFrame([(1, 0, "s", ["a1"]), (1, 1, "s", ["b1"]), (1, 2, "s", ["b2", "b1", "zz"]), (1, 3, "t", ["zz"])], "m int, n int, id string, words array<string>")
    got = U.rewire_segments(segments, kept, aliases, ["m"]).orderBy("n").collect()
    assert [(r.n, r.id, r.words, r.t0, r.t1) for r in got] == [(0, "s", ["a1"], 0.4, 0.7), (2, "s:dup2", ["a1", "b2"], 0.4, 1.0)]
    assert U.union_words(spark.createDataFrame([], WORDS), ["m"])[0].count() == 0


EVENT = "g int, id int, t0 double, t1 double, text string, speaker int, status string, p0 double, p1 double, word_ids array<string>, spans array<string>"


def test_merge_groups(spark):
    rows = [(1, 2, 1.0, 2.0, "b", 5, "guess", 0.9, None, ["w2", "w1"], ["y"]), (1, 1, 0.0, 0.9, "a", 4, "confirmed", None, 1.0, ["w1"], ["x"]), (2, 3, 0.0, 1.0, "c", None, None, None, None, [], []), (3, 4, 0.0, 1.0, "d", 7, "guess", 0.0, 1.0, [], []), (3, 5, 1.0, 2.0, "e", 6, "x", 1.0, 2.0, [], [])]
    got = {r.g: r for r in U.merge_groups(spark.createDataFrame(rows, EVENT), ["g"], "why").collect()}
    one = got[1]
    assert (one.id, one.t0, one.t1, one.text, one.speaker, one.status, one.p0, one.p1, one.word_ids, one.spans) == (1, 0.0, 2.0, "a b", 4, "confirmed", 0.9, 1.0, ["w1", "w2"], ["x", "y"])
    assert (one.trace.op, one.trace.reason, one.trace.ids, one.trace.texts) == ("merge", "why", [1, 2], ["a", "b"])
    assert (got[2].speaker, got[2].status, got[2].p0) == (None, "unknown", None) and (got[3].speaker, got[3].status) == (6, "guess")


def test_projection_states(spark):
    schema = "m int, n int, t0 double, t1 double, p0 double, p1 double, speaker int, region int, split_before boolean, split_after boolean"
    rows = [
        (1, 0, 1.0, 2.0, None, None, 1, None, False, False), (1, 1, 3.0, 20.0, None, None, 1, None, False, False), (1, 2, 21.0, 22.0, None, None, 2, None, False, False), (1, 3, 30.0, 31.0, 29.0, 31.0, None, 1, False, False),
        (1, 4, 40.0, 41.0, None, None, 2, 2, False, False), (1, 5, 50.0, 51.0, None, None, 2, 2, True, False), (1, 6, 60.0, 61.0, None, None, 2, 2, False, False),
    ]
    kind = "m int, id string, at double, confidence double"
    starts = spark.createDataFrame([(1, "s1", 0.8, 0.9), (1, "s0", 1.2, 2.0), (1, "s3", 3.0, 0.5), (1, "s4", 41.2, 0.5), (2, "x", 21.0, 1.0)], kind)
    ends = spark.createDataFrame([(1, "e1", 2.25, 0.4), (1, "e2", 20.0, 0.4), (1, "e4", 41.1, -1.0)], kind)
    p = P.project_boundaries(spark.createDataFrame(rows, schema), starts, ends, ["m"])
    got = {r.n: r for r in p.collect()}
    assert (got[0].state, got[0].start, got[0].start_id, got[0].end, got[0].states) == ("accepted", 0.8, "s1", 2.25, ["proposed", "projected", "accepted"])
    assert (got[1].state, got[1].warnings, got[1].start_id) == ("fallback", ["too_long"], "fallback")  # the next speaker differs
    assert (got[2].state, got[2].warnings, got[2].start_id, got[2].end) == ("merged", ["no_start", "no_end"], "merge-fallback", 22.0)
    assert (got[3].state, got[3].start) == ("fallback", 29.0)  # the next region differs
    assert (got[4].state, got[4].warnings, got[4].end_id) == ("fallback", ["no_start"], "fallback")  # a hard split follows
    assert got[5].state == "merged" and got[6].state == "fallback"  # the last group has no neighbour
    fixed = {r.n: r for r in P.repair_projections(p, spark.createDataFrame([(1, 2, 20.5, 22.5), (1, 0, 9.0, 9.0)], "m int, n int, start double, end double"), ["m"]).collect()}
    assert (fixed[2].state, fixed[2].start, fixed[2].end) == ("one_repair", 20.5, 22.5) and fixed[0].start == 0.8
    assert (fixed[5].state, fixed[5].warnings, fixed[5].states) == ("fallback", ["no_start", "no_end", "repair_failed"], ["proposed", "projected", "merged", "fallback"])
    assert all(b in P.STATES[a] for r in fixed.values() for a, b in zip(r.states, r.states[1:], strict=False))


def test_words_that_stay_are_not_joined_again(spark):
    words = [(1, "a", 0.0, 0.5, "hi", 0.9, "en", 7), (1, "b", 0.1, 0.5, "hi", None, None, 8), (1, "c", 3.0, 3.5, None, None, None, None), (1, "d", 0.0, 0.5, "other", 0.1, "de", 9)]
    df = spark.createDataFrame(words, WORDS + ", place int")
    kept, aliases = U.union_words(df, ["m"])
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == sorted(w for w in words if w[1] != "b")
    assert [(r.id, r.canonical) for r in aliases.collect()] == [("b", "a")]
    assert "Join" not in kept._jdf.queryExecution().executedPlan().toString()
