import random
import re

import pytest

from spanloom.operators import cues as C

CUES = "m int, id int, t0 double, t1 double, text string, words array<struct<text:string,start:double,end:double>>"
shown = lambda s: len(s.replace(" ", "").replace("\n", ""))


def by_loop(cue, shortest=0.8, longest=5.0):
    """Cuts of one cue, step by step: (text, start, end, words)."""
    t0, t1, text, words = cue

    def room(s):
        han = len(re.findall(r"[一-鿿぀-ヿ가-힯]", s))
        return 40 if han / max(1, len(s.replace(" ", ""))) > 0.5 else 84

    def force(text, words, a, z):
        out, now, at, since, total = [], "", 0, 0, max(1, shown(text))
        for p in re.findall(r"[,，;；\s—…]+|[^,，;；\s—…]+", text):
            if re.fullmatch(r"[,，;；\s—…]+", p):
                if now.strip():
                    now += p
                    continue
                at += shown(p)
                since = at
                if out:
                    out[-1][0] = out[-1][0].rstrip() + p
                    out[-1][2] = a + at / total * (z - a)
                continue
            at += shown(p)
            now += p
            if at - since >= room(text) // 2 or at >= total:
                x, y = since / total * (z - a), at / total * (z - a)
                out.append([now.strip(), max(a, a + x), min(z, a + y), [w for w in words if w[1] >= x and w[2] <= y + 0.001]])
                now, since = "", at
        rest = now.strip()
        if rest and out and (shown(rest) <= 4 or shown(rest) / total < 0.25):
            out[-1][0], out[-1][2] = out[-1][0].rstrip() + " " + rest, z
        elif rest:
            out.append([rest, out[-1][2] if out else a, z, []])
        return out or [[text, a, z, words]]

    if t1 - t0 <= longest and shown(text) <= room(text):
        return [[text, t0, t1, words]]
    parts = []
    for p in (p.strip() for p in re.split(r"(?<=[.!?！？。])", text)):
        if p and parts and re.sub(r"[.!?！？。]+$", "", parts[-1].split()[-1]).lower() in C.ABBREVIATIONS:
            parts[-1] += " " + p
        elif p:
            parts.append(p)
    if len(parts) < 2:
        return force(text, words, t0, t1)
    pieces, at, total = [], 0, max(1, shown(text))
    for p in parts:
        x, y = at / total * (t1 - t0), (at + shown(p)) / total * (t1 - t0)
        at += shown(p)
        margin = (y - x) * 0.5
        rest, mine = [w for w in words if w[1] >= x - margin and w[2] <= y + margin], []
        for token in re.findall(r"[\w']+", p.lower()):
            for k, w in enumerate(rest):
                bare = w[0].strip(C.BESIDE).lower()
                if bare in token or token in bare:
                    mine.append(w)
                    rest = rest[k + 1 :]
                    break
        pieces.append([p, t0 + mine[0][1] if mine else max(t0, t0 + x), t0 + mine[-1][2] if mine else min(t1, t0 + y), mine])
    out, i = [], 0
    while i < len(pieces):
        text, a, z, mine = pieces[i]
        i += 1
        if z - a > longest:
            out += force(text, mine, a, z)
            continue
        if z - a < shortest:
            while i < len(pieces) and pieces[i][2] - a <= longest:
                text, z, mine = text + " " + pieces[i][0], pieces[i][2], mine + pieces[i][3]
                i += 1
                if z - a >= shortest:
                    break
        out.append([text, a, z, mine])
    return out


def some_cue(rng):
    words, text, t = [], "", 0.0
    for _ in range(rng.randrange(1, 60)):
        w = rng.choice(["Yes", "dr", "Mr", "well", "it's", "éa", "天气", "好", "a", "long-ish", "understanding", "x1"]) + rng.choice([""] * 6 + [".", "?", "!", ",", "。", ";", "..."])
        d = rng.choice([0.1, 0.2, 0.3, 0.6])
        words.append((w, round(t, 3), round(t + d, 3)))
        t += d + rng.choice([0.0, 0.1])
        text += ("" if rng.random() < 0.1 else " ") + w
    keep = rng.choice([1.0, 0.8, 0.0])
    return 3.0, 3.0 + round(t * rng.choice([1, 1, 2]), 3), text.strip(), [w for w in words if rng.random() < keep]


@pytest.mark.parametrize("seed", [1, 2])
def test_cuts_against_a_loop(spark, seed):
    rng = random.Random(seed)
    cues = [some_cue(rng) for _ in range(60)]
    df = spark.createDataFrame([(i % 3, i, c[0] + 100 * i, c[1] + 100 * i, c[2], c[3]) for i, c in enumerate(cues)], CUES).repartition(3)
    got = {}
    for r in C.split_long(df, ["m"]).orderBy("m", "cue").collect():
        got.setdefault(r.id, []).append([r.text, r.t0, r.t1, [tuple(w) for w in r.words]])
    for i, c in enumerate(cues):
        want = by_loop((c[0] + 100 * i, c[1] + 100 * i, *c[2:]))
        assert [(g[0], g[3]) for g in got[i]] == [(w[0], w[3]) for w in want], i
        assert all(abs(g[k] - w[k]) < 1e-9 for g, w in zip(got[i], want, strict=True) for k in (1, 2)), i


def test_short_null_and_unbroken_cues(spark):
    rows = [(1, 1, 0.0, 2.0, "short one", None), (1, 2, 3.0, 20.0, None, None), (1, 3, 30.0, 50.0, "x" * 200, None), (1, 4, 60.0, 61.0, "第一句话。第二句话。" * 5, [])]
    got = C.split_long(spark.createDataFrame(rows, CUES), ["m"]).orderBy("cue").collect()
    assert [(r.id, r.t0, r.t1) for r in got[:3]] == [(1, 0.0, 2.0), (2, 3.0, 20.0), (3, 30.0, 50.0)] and [r.cue for r in got] == list(range(1, len(got) + 1))
    assert "".join(r.text.replace(" ", "") for r in got[3:]) == "第一句话。第二句话。" * 5 and all(r.t1 - r.t0 <= 5 for r in got[3:])


def test_cuts_are_computed_once(spark):
    """A filter on lists that are never empty would compute every cut twice."""
    rows = [(1, 1, 0.0, 30.0, "one two, three. Four five dr. Six seven", [("one", 0.0, 1.0), ("Four", 9.0, 9.5)])]
    plan = C.split_long(spark.createDataFrame(rows, CUES), ["m"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_words_come_back_as_they_were_and_missing_times_stay(spark):
    words = [("one", None, 1.0), None, (None, 2.0, 3.0), ("Four", 9.0, 9.5)]
    rows = [(1, 1, None, 30.0, "one two. Four" * 10, words), (1, 2, 50.0, 90.0, "\u3000Four words. more", words), (1, 3, 95.0, 96.0, "short", words)]
    got = C.split_long(spark.createDataFrame(rows, CUES), ["m"]).orderBy("cue").collect()
    assert [(r.id, round(r.t0, 3), r.t1, r.text) for r in got if r.id != 1] == [(2, 59.0, 59.5, "Four words."), (2, 76.667, 50 + 14 / 15 * 40, "more"), (3, 95.0, 96.0, "short")]
    assert [(w and tuple(w)) for w in got[-1].words] == words
    # with a start missing, each utterance keeps what is known
    one = [r for r in got if r.id == 1]
    assert len(one) == 11 and all(r.t0 is None and r.t1 == 30.0 and not r.words for r in one)
