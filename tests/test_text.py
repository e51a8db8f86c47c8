from pyspark.sql import functions as F

from spanloom.functions import text as tx


def ask(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "t string").coalesce(1)
    return [r[0] for r in df.select(column(F.col("t"))).collect()]


def test_wrap_middle(spark):
    def plain(t, most, reach=10):
        if len(t) <= most:
            return t
        mid = len(t) // 2
        at = next((p for i in range(reach + 1) for p in (mid + i, mid - i) if 0 < p < len(t) and t[p - 1] in " ,.!?;:，。！？；：、"), mid)
        return t[:at].rstrip(" ") + "\n" + t[at:].lstrip(" ")

    texts = ["short", "a longer line that has to break somewhere", "x" * 41, "one,two,three four five six seven eight", "你好世界，" * 6, ""]
    assert ask(spark, lambda c: tx.wrap_middle(c, 20), *texts) == [plain(t, 20) for t in texts]


def test_counts_and_scripts(spark):
    assert ask(spark, tx.count_words, "two words", "你好 hello", "", None) == [2, 3, 0, 0]
    assert ask(spark, tx.script, "abc", "你好a", "12") == ["latin", "cjk", "other"]
    assert ask(spark, lambda c: F.array_join(tx.numbers(c), ","), "1.5 and 20") == ["1.5,20"]


def test_join_tokens(spark):
    assert ask(spark, lambda c: tx.join_tokens(F.split(c, r"\|")), "Well| |,|yes|(|no|)|.", "你|好|ok", "") == ["Well, yes (no).", "你好ok", ""]


def test_letters(spark):
    df = spark.createDataFrame([(0,), (25,), (26,), (27,)], "n int").coalesce(1)
    assert [r[0] for r in df.select(tx.letters(F.col("n"))).collect()] == ["A", "Z", "AA", "BB"]


def test_long_similarity(spark):
    pair = lambda a, b: spark.createDataFrame([(a, b)], "a string, b string").select(tx.long_similarity(F.col("a"), F.col("b"))).first()[0]
    assert pair("", "") == 1.0
    assert pair("a", "") == 0.0
    assert pair("abcd", "abce") == 0.75
    assert pair("ab" * 150, "ba" * 10) == 1.0


def test_segment_fault(spark):
    n = lambda v: F.lit(v).cast("double")
    fault = lambda *m: lambda c: tx.segment_fault(c, *[n(v) for v in m])
    assert ask(spark, fault(None, None, None), "...", "Thanks for watching!", "hello") == ["empty", "training phrase", None]
    assert ask(spark, fault(0.7, -1.5, None), "hello") == ["no speech"]
    assert ask(spark, fault(0.1, -0.5, 3.0), "go go go", "go home") == ["repetition", None]


def test_normalized_texts(spark):
    cases = {
        "One answer within three rings": "1. answer within three rings.", "one Answer that goes on for very long words": "1. Answer that goes on for very long words.", "two of the many words that follow here": "two of the many words that follow here.",
        "Two": "2.", "three!": "3.!", " Ten, ": "10.", "  ": "  ", "": "", "MAHOOD and suzy, met  Lusty": "MEHOOD and Susie, met Lestie.", "Shao Shi\tcame!": "Xiao Xi came!", "好的": "好的.", "onerous": "onerous.", "five 天气 好": "5. 天气 好.",
    }
    df = spark.createDataFrame(list(cases), "string").toDF("t").select("t", tx.normalized(F.col("t")).alias("n"), tx.normalized(F.col("t"), {}).alias("safe"))
    got = {r.t: (r.n, r.safe) for r in df.collect()}
    assert {t: g[0] for t, g in got.items()} == cases
    assert got["MAHOOD and suzy, met  Lusty"][1] == "MAHOOD and suzy, met Lusty." and spark.range(1).select(tx.normalized(F.lit(None).cast("string"))).first()[0] is None
