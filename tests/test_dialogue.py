import random
import re
from collections import Counter

import pytest

from spanloom.config import Settings, overlay
from spanloom.operators import dialogue as D
from spanloom.operators import words as O


def test_text_speakers(spark):
    rows = [("m", 1, 0.0, 1.0, "Could you help?"), ("m", 2, 1.1, 2.0, "With what"), ("m", 3, 2.1, 3.0, "Yes"), ("m", 4, 3.1, 4.0, None), ("n", 1, 0.0, 1.0, "alone")]
    got = D.text_speakers(spark.createDataFrame(rows, "media_id string, id long, t0 double, t1 double, text string"), ["media_id"])
    assert sorted(map(tuple, got.collect())) == [("m", 1, 0), ("m", 2, 1), ("m", 3, 1), ("m", 4, 1), ("n", 1, 0)]
    rows = [("m", 1, 0.0, 1.0, "One."), ("m", 2, 1.3, 2.0, "Two"), ("m", 3, 2.3, 3.0, "Yes"), ("m", 4, 3.05, 4.0, "Dr. Who"), ("m", 5, 4.0, 5.0, "well"), ("m", 6, 16.0, 17.0, "late")]
    got = D.text_speakers(spark.createDataFrame(rows, "media_id string, id long, t0 double, t1 double, text string"), ["media_id"], parties=9)
    assert [r.speaker_no for r in got.orderBy("id").collect()] == [0, 1, 2, 2, 3, 4]


def anchors_by_loop(left, right):
    def paras(cues):
        out = [[0]]
        for i in range(1, len(cues)):
            if cues[i][0] - cues[i - 1][1] > 2:
                out.append([])
            out[-1].append(i)
        return out

    def top(cues, rows):
        text = " ".join(cues[i][2] for i in rows).lower()
        terms = re.findall("[一-鿿]+", text)
        return {t for t, _ in Counter(terms + [w for w in re.findall("[a-z]{3,}", text) if w not in D.STOP_WORDS]).most_common(5)}

    ends = {(0, 0), (len(left) - 1, len(right) - 1)}
    a, b = paras(left), paras(right)
    if len(a) < 2 or len(b) < 2:
        return ends
    used = set()
    for p in a:
        best, at = 0.1, None
        for k, q in enumerate(b):
            x, y = top(left, p), top(right, q)
            s = len(x & y) / len(x | y) if x | y else 0
            if k not in used and s > best:
                best, at = s, k
        if at is not None:
            used.add(at)
            ends.add((p[len(p) // 2], b[at][len(b[at]) // 2]))
    return ends


def test_anchors_match_a_loop(spark):
    rng = random.Random(5)
    schema, cues = "media_id long, id long, t0 double, t1 double, text string", [[], []]
    made = {}
    for m in range(40):
        for side in (0, 1):
            t, mine = 0.0, []
            for i in range(rng.randrange(1, 12)):
                t += rng.choice([0.5, 0.5, 3.0])
                text = " ".join(rng.choice(["apple", "pear", "plum", "the", "天气", "河", "sky"]) for _ in range(rng.randrange(4)))
                mine.append((t, t + 1, text))
                cues[side].append((m, i, t, t + 1, text))
                t += 1
            made[m, side] = mine
    got = D.paragraph_anchors(*[spark.createDataFrame(c, schema) for c in cues], ["media_id"]).collect()
    for m in range(40):
        assert {(r.left_row, r.right_row) for r in got if r.media_id == m} == anchors_by_loop(made[m, 0], made[m, 1]), m


def test_segment_words(spark):
    words = [("e", i, w, i * 0.5, i * 0.5 + 0.4) for i, w in enumerate(["Well", "done.", "Now", None, "rest"])]
    found = O.segment_words(spark.createDataFrame(words, "cue string, pos int, word string, t0 double, t1 double"), ["cue"]).orderBy("piece").collect()
    assert [(r.piece, r.n_words, r.text) for r in found] == [(0, 2, "Well done."), (1, 3, "Now  rest")]


def test_claims_and_grouping(spark):
    claims = spark.createDataFrame([("m", 1, 2, "b"), ("m", 1, 1, "a"), ("m", 2, 2, "c")], "media_id string, id long, window int, grp string")
    assert sorted(r.grp for r in D.first_claims(claims, ["media_id"]).collect()) == ["a", "c"]
    groups = spark.createDataFrame([("m", 1, 1), ("m", 1, 2), ("m", 1, 3), ("m", 2, 3), ("m", 2, 9)], "media_id string, grp int, id long")
    members = spark.createDataFrame([("m", 1, 1, True), ("m", 2, 2, False), ("m", 3, 3, True)], "media_id string, id long, pos int, hard boolean")
    assert sorted(map(tuple, D.check_grouping(groups, members, ["media_id"]).collect())) == [("m", 1, 0, 0, 1), ("m", 2, 1, 1, 0)]


def test_nearest_of_direction(spark):
    t = spark.createDataFrame([(1, "m", 1.0, "left"), (2, "m", 9.0, "left")], "id long, media_id string, t double, direction string")
    c = spark.createDataFrame([("m", "left", 1.25, 1), ("m", "left", 0.75, 0), ("m", "right", 1.0, 2)], "media_id string, direction string, at double, ord int")
    assert sorted((r.id, r.at) for r in O.nearest_of_direction(t, c, ["media_id"]).collect()) == [(1, 0.75), (2, None)]


def test_settings(tmp_path):
    (tmp_path / "one.json").write_text('{"pipeline": {"vad": {"threshold": 0.7}}, "cache": {"enabled": false}}')
    s = Settings.profile(tmp_path, "one")
    assert (s["vad.threshold"], s["vad.min_speech_duration_ms"], s["cache.enabled"], s.get("no.such", 3)) == (0.7, 250, False, 3)
    assert s.with_(vad__threshold=0.2)["vad.threshold"] == 0.2 and s["vad.threshold"] == 0.7
    assert ("cache.enabled", "false") in list(s.rows()) and Settings.profiles(tmp_path) == ["one"]
    assert overlay({"a": {"b": 1}}, {"a": 2}) == {"a": 2}
    with pytest.raises(FileNotFoundError):
        Settings.profile(tmp_path, "two")
    with pytest.raises(KeyError):
        s["vad.nothing"]
    pytest.importorskip("yaml")
    (tmp_path / "three.yaml").write_text("pipeline:\n  subtitle:\n    max_duration: 4.0\n")
    assert Settings.profile(tmp_path, "three")["subtitle.max_duration"] == 4.0
