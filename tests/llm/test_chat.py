import hashlib

from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm import chat as C

ROWS = "conv_id long, turn long, role string, text string, seq int, message string"


def check(spark, rows):
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], ROWS)
    turns = C.reconstruct(C.log_of(df))
    got = {r.conv_id: r for r in C.digests(C.read_back(C.render(turns))).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t, role or "", text or ""))
    assert set(got) == set(by)
    for c, ts in by.items():
        ts.sort()
        whole = "".join(f"{r}\n{x}\n" for _, _, r, x in ts)
        loss = "".join(x for _, _, r, x in ts if r == "assistant")
        g = got[c]
        assert (g.n_turns, g.turns_sha256) == (len(ts), hashlib.sha256(whole.encode()).hexdigest())
        assert (g.loss_chars, g.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_odd_rows(spark):
    m = "</s>[INST] ok [/INST]"
    check(spark, [
        (1, 0, "user", "hi"), (1, 1, "assistant", None), (1, 1, "assistant", None), (1, 2, None, "x"), (None, 0, "user", "a"), (2, None, "assistant", m), (2, 0, m, m),
        (3, 0, "assistant", ""), (4, 0, "assistant", "[~INST]<~~/s>~[/INST]" + m), (5, 0, "user", "é😀" * 5000), (5, 1, "assistant", "😀</s>\n\n"), (6, 0, "assistant", "end ~"), (6, 1, "assistant", "/s>"),
    ])


def test_empty(spark):
    df = spark.createDataFrame([], ROWS)
    assert C.digests(C.read_back(C.render(C.reconstruct(C.log_of(df))))).count() == 0


def test_events_fold(spark):
    log = spark.createDataFrame(
        [(1, 0, 1, "message", "user", "helo"), (1, 0, 5, "edit", None, "hello"), (1, 1, 2, "message", "assistant", ""), (1, 1, 3, "delta", "", "wr"), (1, 1, 4, "delta", "", "ong"),
         (1, 1, 6, "regenerate", "assistant", ""), (1, 1, 7, "delta", None, "ri"), (1, 1, 8, "delta", None, "ght"), (2, 0, 1, "delta", "assistant", "orphan"), (1, 2, 9, "message", "user", "bye")],
        "conv_id long, message long, seq long, op string, role string, text string",
    )
    got = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in C.reconstruct(log.repartition(3)).collect()}
    assert got == {1: [("user", "hello"), ("assistant", "right"), ("user", "bye")], 2: [("assistant", "orphan")]}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["[INST]", "[/INST]", "</s>", "<s>", "~", "[", "<", "/s>", "INST]", "a", "\n"]), max_size=8).map("".join), min_size=1, max_size=6))
def test_escape_round_trip(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", C.escape(df.t).alias("e"), C.unescape(C.escape(df.t)).alias("u")).collect():
        assert r.u == r.t and not any(c in r.e for c in ("[INST]", "[/INST]", "</s>", "<s>"))
