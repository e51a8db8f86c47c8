import numpy as np
import pytest

from spanloom.operators import frames as R
from spanloom.operators import speakers as S

TURNS, EVENTS = "m int, id int, speaker int, t0 double, t1 double", "m int, id int, label int, t0 double, t1 double"


def test_mapping_is_one_to_one_or_none(spark):
    turns = spark.createDataFrame([(1, 1, 10, 0.0, 5.0), (1, 2, 11, 5.0, 10.0), (2, 1, 10, 0.0, 5.0), (2, 2, 11, 5.0, 6.0)], TURNS)
    events = spark.createDataFrame([(1, 1, 0, 0.0, 6.0), (1, 2, 1, 6.0, 7.0), (1, 3, None, 7.0, 9.0), (2, 1, 0, 0.0, 6.0)], EVENTS)
    got = {(r.m, r.speaker, r.label) for r in S.map_speakers(turns, events, ["m"], 4.0).collect()}
    assert got == {(1, 10, 0), (1, 11, 1)}  # the second recording has a speaker without a label, so no mapping


def test_fusion(spark):
    turns = spark.createDataFrame([(1, 1, 10, 0.0, 5.0), (1, 2, 11, 5.0, 10.0)], TURNS)
    events = spark.createDataFrame([(1, 1, 7, 0.0, 4.0), (1, 2, 9, 5.0, 8.0), (1, 3, 7, 8.0, 9.0), (1, 4, None, 4.0, 4.5), (1, 5, 9, 20.0, 21.0), (1, 6, None, 30.0, 31.0)], EVENTS)
    got = {r.id: (r.source, r.speaker, r.name, r.repair) for r in S.fuse_speakers(events, turns, ["m"], 4.0).collect()}
    # ids 7, 9 and 10 (a turn without an own label) are numbered from 0
    assert got == {
        1: ("fused", 0, "Speaker A", ""), 2: ("fused", 1, "Speaker B", ""), 3: ("unknown", None, None, "speaker_evidence_conflict"), 4: ("global", 2, "Speaker C", ""),
        5: ("embedding", 1, "Speaker B", ""), 6: ("unknown", None, None, "speaker_evidence_unavailable"),
    }


def test_voice_changes(spark):
    rows = [(1, 1, 0.0, 1.0, [1.0, 0.0]), (1, 2, 1.2, 2.0, [-1.0, 0.0]), (1, 3, 1.9, 3.0, [1.0, 0.0]), (1, 4, 5.0, 6.0, None), (1, 5, 6.0, 7.0, [0.0, 0.0]), (1, 6, 7.0, 8.0, [1.0, 0.0])]
    got = [(r.at, round(r.score, 6)) for r in S.voice_changes(spark.createDataFrame(rows, "m int, id int, t0 double, t1 double, v array<double>"), ["m"]).orderBy("at").collect()]
    assert got == [(1.0, 0.96), (1.9, 0.8)]


def plain(rms, hop, window, least, close, shortest, fallback, floor, ceiling):
    n, out = len(rms), []
    if n * hop < shortest:
        return [(0.0, n * hop, floor, 0.0, fallback, False, 0)]
    x = np.clip(rms, floor, ceiling)
    step = max(1, window // 2)
    items = []
    for a in range(0, n, step):
        part = x[a : a + window]
        db = np.percentile(20 * np.log10(part), 25) if len(part) >= least else fallback
        mad = np.median(np.abs(part - np.median(part))) * 1.4826 if len(part) > 1 else 0.0
        items.append([a * hop, (a + len(part)) * hop, np.median(part), mad, db, len(part) >= least, len(part)])
    for k, i in enumerate(items):
        if out and abs(i[4] - out[-1][4]) < close:
            p, total = out[-1], out[-1][6] + i[6]
            out[-1] = [p[0], i[1], (p[2] * p[6] + i[2] * i[6]) / total, max(p[3], i[3]), (p[4] * p[6] + i[4] * i[6]) / total, p[5] and i[5], total]
        elif not out or i[1] - out[-1][1] >= shortest or k == len(items) - 1:
            out.append(i)
    return [tuple(i) for i in out]


@pytest.mark.parametrize("window", [1, 3, 4])
def test_noise_profile_against_numpy(spark, window):
    rng = np.random.default_rng(window)
    levels = np.repeat(rng.choice([0.001, 0.01, 0.1, 0.0, 2.0], 12), 7)
    recordings = {1: levels * rng.uniform(0.7, 1.3, len(levels)), 2: np.array([0.01] * 3), 3: rng.uniform(0, 1, 41)}
    df = spark.createDataFrame([(m, k, float(v)) for m, x in recordings.items() for k, v in enumerate(x)], "m int, k long, rms double").repartition(3)
    got = {}
    for r in R.noise_profile(df, ["m"], 0.5, window).orderBy("m", "t0").collect():
        got.setdefault(r.m, []).append((r.t0, r.t1, r.rms, r.mad, r.db, r.stable, r.frames))
    for m, x in recordings.items():
        want = plain(x, 0.5, window, 4, 3.0, 2.0, -35.0, 1e-6, 0.5)
        assert len(got[m]) == len(want) and np.allclose([[float(c) for c in w] for w in got[m]], [[float(c) for c in w] for w in want], atol=1e-9), m
