import collections
import itertools
import random
import re

import pytest

import corpus_pipeline as P
from spanloom.llm import shingles as S
from spanloom.llm import simhash as D

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def groups(texts):
    sets, up = [plain(t) for t in texts], list(range(len(texts)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                up[find(i)] = find(j)
    out = {}
    for i in range(len(texts)):
        out.setdefault(find(i), set()).add(i)
    return list(out.values())


def copies(rng, base, n, changes):
    out = []
    for _ in range(n):
        words = base.split()
        for _ in range(rng.randrange(changes + 1)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def some_texts(rng, hot):
    texts = []
    for _ in range(25):
        base = " ".join(f"w{rng.randrange(10**5)}" for _ in range(rng.randrange(3, 160)))
        texts += copies(rng, base, rng.randrange(1, 6), 5)
    base = " ".join(f"w{rng.randrange(10**5)}" for _ in range(120))
    return texts + copies(rng, base, hot, 4) + ["a b", "A  b", "", None, "word " * 50]


def test_near_stage_keeps_one_of_each_group_at_four_fifths(spark):
    base = " ".join(f"w{i}" for i in range(100))
    close = base.replace("w40 ", "x ").replace("w70 ", "y ")  # 86 of 106 shingles, more than 4 bits apart
    far = base.replace("w20 ", "x ").replace("w40 ", "y ").replace("w70 ", "z ")  # 81 of 111
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate([base, close, far])], DOCS).coalesce(1)
    assert {r.doc_id for r in P.near(spark, docs, "").collect()} == {0, 2}


@pytest.mark.parametrize("shard,ring,sample,common,rounds", [(4096, 16, 20_000, 4, 6), (7, 2, 50, 2, 2), (4096, 10**6, 1, 10**6, 1)])
def test_every_pair_is_found(spark, monkeypatch, shard, ring, sample, common, rounds):
    for name, value in (("SHARD", shard), ("RING", ring), ("SAMPLE", sample), ("COMMON", common), ("ROUNDS", rounds)):
        monkeypatch.setattr(S, name, value)
    rng = random.Random(shard + ring)
    texts = some_texts(rng, 60)
    rng.shuffle(texts)
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], DOCS).repartition(3)
    kept = {r.doc_id for r in D.drop_near(docs).collect()}
    want = groups(texts)
    assert len(kept) == len(want) and all(len(kept & g) == 1 for g in want)


def test_texts_that_differ_in_repeats_are_linked(spark):
    """Repeated words and lines weigh nothing in the similarity, so they must not keep fingerprints apart."""
    rng, texts = random.Random(11), []
    for k in range(20):
        words = [f"v{rng.randrange(10**5)}" for _ in range(120)]
        texts += [" ".join(words + ["again"] * 8), " ".join(words + ["again"] * (100 + 40 * k))]
    line = "this line of eight words stands many times\n"
    for k in range(20):
        body = "\n".join(" ".join(f"u{rng.randrange(10**5)}" for _ in range(12)) for _ in range(15)) + "\n"
        texts += [body + line * 2, body + line * (50 + 20 * k)]
    want = groups(texts)
    assert len(want) == 40
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], DOCS).repartition(3)
    assert {r.doc_id for r in D.drop_near(docs).collect()} == {min(g) for g in want}


def test_frequent_shingles_are_dealt_to_packs(spark, monkeypatch):
    monkeypatch.setattr(S, "PACK", 16)
    rng = random.Random(12)
    texts = some_texts(rng, 200)
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in enumerate(texts)], DOCS).repartition(3)
    kept = {r.doc_id for r in D.drop_near(docs).collect()}
    want = groups(texts)
    assert len(kept) == len(want) and kept == {min(g) for g in want}


def test_what_stays_does_not_depend_on_the_order_of_rows(spark):
    rng = random.Random(13)
    texts = some_texts(rng, 40)
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(texts)] + [(None, texts[0], "en", "a", 1), (3, texts[3], "en", "a", 1)]
    kept = set()
    for turn, parts in enumerate((1, 3, 7)):
        random.Random(turn).shuffle(rows)
        docs = spark.createDataFrame(rows, DOCS).repartition(parts)
        once = P.exact(spark, docs, "")
        kept.add((frozenset((r.doc_id, r.text) for r in once.collect()), frozenset((r.doc_id, r.text) for r in P.near(spark, once, "").collect()), frozenset(tuple(sorted((r.doc_id or -1, r.text) for r in P.mixed(spark, once, "").where("text is not null").collect())))))
    assert len(kept) == 1


def test_odd(odd_docs, no_docs):
    texts = [r.text for r in odd_docs.collect()]
    assert D.drop_near(odd_docs).count() == len(groups(texts)) and D.drop_near(odd_docs).columns == odd_docs.columns
    assert D.drop_near(no_docs).count() == 0


def test_merged_groups_hold_every_pair(spark):
    rng, rows = random.Random(15), []
    for family in range(5):
        members = list(range(100 * family, 100 * family + 30))
        for g in range(40):
            rows += [(1000 * family + g, r) for r in rng.sample(members, rng.randrange(2, 30))]
    rows += [(10_000 + g, r) for g in range(300) for r in (7, 600 + g)]  # a text that meets many others one by one
    rows += [(20_000 + g, r) for g in range(40) for r in {rng.randrange(500) for _ in range(6)}]
    size = {}
    for g, _ in rows:
        size[g] = size.get(g, 0) + 1
    shared = spark.createDataFrame([(g, r, 100, r, size[g]) for g, r in rows], "shingle long, row long, n int, fp long, size long").repartition(3)
    out = S.merged(shared).collect()
    sets = lambda it: {g: {r for h, r in rs} for g, rs in itertools.groupby(sorted(it), key=lambda x: x[0])}
    met = sets((r.shingle, r.row) for r in out)
    pairs = lambda some: {p for s in some.values() for p in itertools.combinations(sorted(s), 2)}
    assert pairs(sets(rows)) <= pairs(met)
    assert len(out) == sum(map(len, met.values())) and all(r.size == len(met[r.shingle]) and r.fp == r.row and r.n == 100 for r in out)
    assert len(out) < len(rows) // 2 and max(map(len, met.values())) < 100
    assert sum(len(s) ** 2 for s in met.values()) <= sum(len(s) ** 2 for s in sets(rows).values())


def test_common_shingles_are_known_in_tables_beyond_the_sample(spark, monkeypatch):
    monkeypatch.setattr(S, "SAMPLE", 50)
    rng = random.Random(16)
    lines = [" ".join(f"l{k}x{i}" for i in range(5)) for k in range(10)]
    texts = [f"{line} {rng.randrange(10**9)} {rng.randrange(10**9)}" for line in lines for _ in range(60)]
    texts += [" ".join(f"w{rng.randrange(10**9)}" for _ in range(8)) for _ in range(1400)]
    held = spark.createDataFrame(list(enumerate(texts)), "_row long, text string").repartition(3)

    def meeting():
        """Texts that meet under a line, at most."""
        met = collections.Counter(S._first([S.shingles(t) for t in texts], *S.common(held))[0].tolist())
        return max(met[int(S.shingles(line)[0])] for line in lines)

    fine = meeting()
    monkeypatch.setattr(S, "SHARE", 10**6)  # by the sample alone
    assert fine <= 2 * S.RING < meeting()
