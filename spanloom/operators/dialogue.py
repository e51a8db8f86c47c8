"""Turns of a dialogue without a model: speakers from pauses, windows of fragments, and who owns a fragment."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ORDER = ("t0", "t1", "id")
#: What a question holds, how a short reply begins, how people are addressed, and what ends a sentence.
QUESTION = (
    r"\?|吗[？?]|呢[？?]|吧[？?]|[Hh]ow may|[Ww]hat |[Cc]an I|[Ww]hy |[Ww]hen |[Ww]here |[Ii]s that|[Aa]re you|[Ww]ould you|[Cc]ould you|[Dd]o you|"
    "怎么|为什么|如何|哪里|哪个|什么|谁|哪[一位]|何时|请问|请教|怎么看|觉得|认为|能不能|可不可以|是否|有没有|是不是|对吧|对吗|是吧|是吗|可以吗|行吗|好吗"
)
REPLY = "^(Yeah|Yes|OK|Okay|Got it|Right|Sure|Alright|I see|好的|好[的了]|嗯[嗯哼]|对|是的|没错|知道了|明白|My pleasure|See you|Thank you)"
ADDRESS = r"(?U)\b(Mr\.|Ms\.|Mrs\.|Miss|Dr\.)\s+\w+|(教授|老师|先生|女士|总[监经]|博士|医生|律师|主播|嘉宾|导演|演员|记者|解说|主持)"
SENTENCE_END = r"[.!?。！？]\s*$"
#: Words that tell nothing of a paragraph.
STOP_WORDS = (
    "the a an is are was were be been being have has had do does did will would could should may might can shall i you he she it we they me him "
    "her us them my your his its our their this that these those and but or nor not so yet for in on at to from with of by as if then than "
    "的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这"
).split()


def gap_speakers(spans: DataFrame, by: Sequence[str]) -> DataFrame:
    """Spans with ``speaker_no`` from the pauses alone: a pause of the median or more switches to a new speaker, a very short one back.

    The switching threshold is the median positive pause (0.3 where there is none) held in [0.08, 0.5]; up to 0.3 of the
    median (0.03 at least) switches back. Let k count the switches before a span and m the switches back since the last.
    The speaker is k for even m and else the partner of k; the partner of an odd k is the speaker before switch k, and
    an even k keeps the partner of k - 1. So the automaton comes down to counts and one last value.
    """
    w = W.partitionBy(*by).orderBy(*ORDER)
    before = w.rowsBetween(W.unboundedPreceding, -1)
    gaps = spans.withColumn("_gap", F.lead("t0").over(w) - F.col("t1"))
    mid = gaps.groupBy(*by).agg(F.coalesce(F.median(F.when(F.col("_gap") > 0, F.col("_gap"))), F.lit(0.3)).alias("_mid"))
    g = gaps.join(mid, [*by])
    switch = F.col("_gap") >= F.least(F.lit(0.5), F.greatest(F.lit(0.08), F.col("_mid")))
    back = ~switch & (F.col("_gap") > 0) & (F.col("_gap") <= F.greatest(F.lit(0.03), F.col("_mid") * 0.3))
    g = g.withColumn("_sw", F.coalesce(switch.cast("int"), F.lit(0))).withColumn("_bk", F.coalesce(back.cast("int"), F.lit(0)))
    g = g.withColumn("_k", F.coalesce(F.sum("_sw").over(before), F.lit(0)))
    inner = W.partitionBy(*by, "_k").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, -1)
    g = g.withColumn("_m", F.when(F.col("_k") == 0, 0).otherwise(F.coalesce(F.sum("_bk").over(inner), F.lit(0))))
    # at the first span after switch k the row before it tells whether k - 1 ended on its own speaker
    # (the row before closes its stretch: it switches, so it has no switch back of its own)
    prior = F.lag("_m").over(w)
    opened = F.lag("_sw").over(w) == 1
    partner = F.when(opened & (F.col("_k") % 2 == 1) & (prior % 2 == 0), F.col("_k") - 1)
    g = g.withColumn("_p", partner).withColumn("_p", F.last("_p", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)))
    out = F.when(F.col("_m") % 2 == 0, F.col("_k")).otherwise(F.col("_p"))
    return g.withColumn("speaker_no", out.cast("long")).drop("_gap", "_mid", "_sw", "_bk", "_k", "_m", "_p")


def fragment_windows(fragments: DataFrame, by: Sequence[str], most: int = 10, seconds: float = 30.0, overlap: int = 1) -> DataFrame:
    """Windows of up to ``most`` fragments that never reach over a hard split: by, window (from 1), first, last, n, w0, w1.

    Fragments are (by, id, t0, t1, hard). A window closes once it lasts ``seconds``; the next one starts ``overlap``
    fragments before its end, one fragment on at least. Every path of windows visits a hard split, so the stretches
    between splits are independent, and a fold over one stretch follows the jumps.
    """
    w = W.partitionBy(*by).orderBy(*ORDER)
    run = fragments.withColumn("_run", F.sum(F.coalesce(F.col("hard"), F.lit(False)).cast("int")).over(w.rowsBetween(W.unboundedPreceding, 0)))
    r = W.partitionBy(*by, "_run").orderBy(*ORDER)
    ahead = F.collect_list("t1").over(r.rowsBetween(0, most - 1))
    run = run.withColumn("_pos", F.row_number().over(r)).withColumn("_ends", ahead)
    full = F.array_position(F.transform("_ends", lambda e: e - F.col("t0") >= seconds), F.lit(True))
    run = run.withColumn("_n", F.when(full > 0, full).otherwise(F.size("_ends")).cast("int"))
    item = F.struct("_pos", "_n", "id", "t0", "t1")
    runs = run.groupBy(*by, "_run").agg(F.array_sort(F.collect_list(item)).alias("_f"))
    zero = F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("starts"))

    def step(s, x):
        jump = F.struct((x["_pos"] + F.greatest(x["_n"] - overlap, F.lit(1))).alias("next"), F.concat(s["starts"], F.array(x["_pos"])).alias("starts"))
        return F.when(x["_pos"] == s["next"], jump).otherwise(s)

    start = runs.select(*by, "_run", "_f", F.explode(F.aggregate("_f", zero, step, lambda s: s["starts"])).alias("_at"))
    a = F.element_at("_f", F.col("_at"))
    z = F.element_at("_f", F.col("_at") + a["_n"] - 1)
    found = start.select(*by, "_run", "_at", a["id"].alias("first"), z["id"].alias("last"), a["_n"].alias("n"), a["t0"].alias("w0"), z["t1"].alias("w1"))
    number = F.row_number().over(W.partitionBy(*by).orderBy("_run", "_at"))
    return found.withColumn("window", number).drop("_run", "_at")


def first_claims(claims: DataFrame, by: Sequence[str]) -> DataFrame:
    """Of the windows that claim a fragment (by, id, window, …) the first one; its other columns come along."""
    w = W.partitionBy(*by, "id").orderBy("window")
    return claims.withColumn("_k", F.row_number().over(w)).where("_k = 1").drop("_k")


def check_grouping(groups: DataFrame, members: DataFrame, by: Sequence[str]) -> DataFrame:
    """Faults of proposed groups (by, grp, id) against a window's fragments (by, id, pos, hard): by, grp, unknown, repeated, crosses.

    ``unknown`` counts ids that the window lacks, ``repeated`` ids that an earlier row of the window names, and ``crosses``
    the members after the group's first that follow a hard split.
    """
    j = groups.join(members, [*by, "id"], "left")
    again = F.row_number().over(W.partitionBy(*by, "id").orderBy("grp")) > 1
    first = F.min("pos").over(W.partitionBy(*by, "grp"))
    j = j.withColumn("_again", again).withColumn("_cross", F.coalesce(F.col("hard") & (F.col("pos") > first), F.lit(False)))
    return j.groupBy(*by, "grp").agg(F.count_if(F.col("pos").isNull()).alias("unknown"), F.count_if("_again").alias("repeated"), F.count_if("_cross").alias("crosses"))


def text_speakers(segments: DataFrame, by: Sequence[str], parties: int = 2, pause: float = 0.25) -> DataFrame:
    """by, id, speaker_no of segments (id, t0, t1, text) by what the texts look like: the parties take turns.

    A turn begins after a question or an address, and after a pause where the text before it ends a sentence or only one of the two
    is a short reply. A pause beyond ten seconds parts all. A null text shows nothing.
    """
    w = W.partitionBy(*by).orderBy(*ORDER)
    text = F.coalesce("text", F.lit(""))
    shown = {"asks": text.rlike(QUESTION) | text.rlike(ADDRESS), "reply": F.regexp_replace(text, r"^\s+", "").rlike(REPLY), "ends": text.rlike(SENTENCE_END)}
    seen = segments.select(*by, *ORDER, *[c.alias(n) for n, c in shown.items()])
    before = {n: F.lag(n).over(w) for n in ("t1", *shown)}
    gap = F.col("t0") - before["t1"]
    begins = before["asks"] | (gap > 10) | ((gap >= pause) & (before["ends"] | (F.col("reply") != before["reply"])))
    turn = F.sum("_begins").over(w)
    return seen.withColumn("_begins", F.coalesce(begins, F.lit(False)).cast("int")).select(*by, "id", (turn % parties).alias("speaker_no"))


def paragraphs(cues: DataFrame, by: Sequence[str], gap: float = 2.0) -> DataFrame:
    """Cues with ``row`` (from 0 in time order) and ``para`` (from 0): a pause above ``gap`` opens a paragraph."""
    w = W.partitionBy(*by).orderBy(*ORDER)
    opens = F.coalesce((F.col("t0") - F.lag("t1").over(w) > gap).cast("int"), F.lit(0))
    marked = cues.withColumn("row", F.row_number().over(w) - 1).withColumn("_n", opens)
    return marked.withColumn("para", F.sum("_n").over(w.rowsBetween(W.unboundedPreceding, 0)).cast("int")).drop("_n")


def keywords(paras: DataFrame, by: Sequence[str], k: int = 5) -> DataFrame:
    """by, para, term, terms: the ``k`` most frequent terms of a paragraph (runs of Han, words of a-z from three letters on); ties go to Han, then to the first."""
    text = F.lower(F.coalesce("text", F.lit("")))
    han = F.transform(F.regexp_extract_all(text, F.lit(r"[\x{4E00}-\x{9FFF}]+"), F.lit(0)), lambda t, i: F.struct(F.lit(0).alias("kind"), i.alias("place"), t.alias("term")))
    latin = F.transform(F.regexp_extract_all(text, F.lit("[a-z]{3,}"), F.lit(0)), lambda t, i: F.struct(F.lit(1).alias("kind"), i.alias("place"), t.alias("term")))
    said = paras.select(*by, "para", "row", F.inline(F.concat(han, latin))).where((F.col("kind") == 0) | ~F.col("term").isin(STOP_WORDS))
    counts = said.groupBy(*by, "para", "kind", "term").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("row", "place")).alias("_at"))
    rank = F.row_number().over(W.partitionBy(*by, "para").orderBy(F.desc("_n"), "kind", "_at"))
    top = counts.withColumn("_k", rank).where(F.col("_k") <= k)
    return top.select(*by, "para", "term", F.count(F.lit(1)).over(W.partitionBy(*by, "para")).alias("terms"))


def paragraph_anchors(left: DataFrame, right: DataFrame, by: Sequence[str], gap: float = 2.0, least: float = 0.1) -> DataFrame:
    """Pairs of rows that an alignment may hold to: by, left_row, right_row, always with both ends.

    Paragraphs pair by the Jaccard index of their keywords above ``least``: each left one in order takes the best free
    right one, the first at a tie, and the middles become anchors. Without a pause above ``gap`` on both sides only the
    ends are given. Only paragraphs with a common keyword meet, by an equi-join; the kernel sees their numbers.
    """
    l, r = paragraphs(left, by, gap), paragraphs(right, by, gap)
    shape = lambda p, side: p.groupBy(*by).agg((F.max("row")).alias(f"{side}_last"), F.max("para").alias(f"{side}_paras"))
    size = shape(l, "left").join(shape(r, "right"), [*by])
    a = keywords(l, by).withColumnsRenamed({"para": "a", "terms": "_ta"})
    b = keywords(r, by).withColumnsRenamed({"para": "b", "terms": "_tb"})
    met = a.join(b, [*by, "term"]).groupBy(*by, "a", "b").agg(F.count(F.lit(1)).alias("_c"), F.any_value("_ta").alias("_ta"), F.any_value("_tb").alias("_tb"))
    links = met.withColumn("score", F.col("_c") / (F.col("_ta") + F.col("_tb") - F.col("_c"))).where(F.col("score") > least)
    links = links.join(size.where("left_paras > 0 AND right_paras > 0").select(*by), [*by]).select(*by, "a", "b", "score")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        used, rows = set(), []
        for x in pdf.sort_values(["a", "score", "b"], ascending=[True, False, True]).itertuples(index=False):
            if x.b not in used and not (rows and rows[-1][0] == x.a):
                used.add(x.b)
                rows.append((x.a, x.b))
        return pd.DataFrame([[*pdf[list(by)].iloc[0], *r] for r in rows], columns=[*by, "a", "b"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in left.select(*by).schema)
    pairs = links.groupBy(*by).applyInPandas(one, f"{schema}, a int, b int")
    middle = lambda p, para, row: p.groupBy(*by, "para").agg((F.min("row") + F.floor(F.count(F.lit(1)) / 2)).cast("int").alias(row)).withColumnRenamed("para", para)
    inner = pairs.join(middle(l, "a", "left_row"), [*by, "a"]).join(middle(r, "b", "right_row"), [*by, "b"]).select(*by, "left_row", "right_row")
    first = size.select(*by, F.lit(0).alias("left_row"), F.lit(0).alias("right_row"))
    return inner.unionByName(first).unionByName(size.select(*by, F.col("left_last").alias("left_row"), F.col("right_last").alias("right_row"))).distinct()
