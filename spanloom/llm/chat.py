"""Chat formatting by event-sourced reconstruction, in DataFrame functions only.

A log holds events (conv_id, message, seq, op, role, text). `message` begins a message, `delta`
appends a streamed piece, `edit` replaces the text, `regenerate` throws the text away for a new one.
Events are partitioned by conversation and message, sorted by sequence and folded in one pass, so a long stream of
one message is done before its conversation is put together. The conversation is one output row
and so one value; Spark holds up to 2 GB in it.

A template marks turns by control strings. Inside texts and roles a `~` is put after the first
character of anything that reads as a control string, and one more where some are there already, so
the escape is undone exactly.

Defined cases: null texts and roles are empty; a null turn sorts first; a null conv_id is a
conversation; ties of sequence sort by role and text, and repeated rows are turns of their own; an
event before the first `message` of its group begins one; an empty log gives an empty result. Extra
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: The template: OPEN role MIDDLE text CLOSE for each turn.
OPEN, MIDDLE, CLOSE = "[INST]", "[/INST]", "</s>"
#: A control string as it stands in a text: its first character, the tildes put in, its rest.
ESCAPE = r"([<\[])(~*)(/?s>|/?INST\])"
UNESCAPE = r"([<\[])~(~*)(/?s>|/?INST\])"
#: Roles whose texts are trained on; deltas by which a text of theirs is streamed in `log_of`.
TRAINED = ("assistant",)
PIECES = 4


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, "$1~$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def log_of(conversations: DataFrame) -> DataFrame:
    """An event log that ends in the rows (conv_id, turn, role, text), as a client that streams would have written it.

    A row of a trained role begins empty, streams a first draft, is regenerated and streams its text in PIECES deltas; other rows are
    begun with a draft and edited to their text. A message's key is (turn, n), n telling rows of one turn apart.
    """
    n = F.row_number().over(W.partitionBy("conv_id", "turn").orderBy(F.col("role"), F.col("text")))
    rows = conversations.select("conv_id", "turn", n.alias("n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    size = F.length("text")
    cut = [F.floor(size * i / PIECES).cast("int") for i in range(PIECES + 1)]
    pieces = [F.substring("text", cut[i] + 1, cut[i + 1] - cut[i]) for i in range(PIECES)]

    def event(seq: int, op: str, text: Column, role: Column) -> Column:
        return F.struct(F.lit(seq).cast("long").alias("seq"), F.lit(op).alias("op"), role.alias("role"), text.alias("text"))

    none, role = F.lit(None).cast("string"), F.col("role")
    streamed = [event(0, "message", F.lit(""), role), event(1, "delta", pieces[-1], none), event(2, "regenerate", F.lit(""), none)]
    streamed += [event(3 + i, "delta", p, none) for i, p in enumerate(pieces)]
    written = [event(0, "message", pieces[0], role), event(1, "edit", F.col("text"), none)]
    events = F.when(F.col("role").isin(*TRAINED), F.array(*streamed)).otherwise(F.array(*written))
    log = rows.select("conv_id", F.struct("turn", "n").alias("message"), F.explode(events).alias("e"))
    return log.select("conv_id", "message", "e.seq", "e.op", "e.role", "e.text")


def reconstruct(log: DataFrame) -> DataFrame:
    """(conv_id, turns array<struct<role, text>>) in order of message.

    A message's text is that of the last event that sets it (`message`, `edit`, `regenerate`) and of the deltas after it, so each event is read once.
    """
    events = log.select("conv_id", "message", "seq", F.coalesce("op", F.lit("message")).alias("op"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    so_far = W.partitionBy("conv_id", "message").orderBy("seq", "role", "text").rowsBetween(W.unboundedPreceding, 0)
    begun = F.sum(F.when(F.col("op") == "message", 1).otherwise(0)).over(so_far)
    set_ = F.sum(F.when(F.col("op") == "delta", 0).otherwise(1)).over(so_far)
    placed = events.withColumn("part", begun).withColumn("state", set_).withColumn("at", F.row_number().over(W.partitionBy("conv_id", "message").orderBy("seq", "role", "text")))
    states = placed.groupBy("conv_id", "message", "part", "state").agg(
        F.array_sort(F.collect_list(F.struct("at", "text"))).alias("texts"), F.max(F.when(F.col("role") != "", F.struct("at", "role"))).alias("named")
    )
    last = F.max(F.struct("state", "texts")).alias("last")
    said = states.groupBy("conv_id", "message", "part").agg(last, F.max("named")["role"].alias("role"))
    said = said.select("conv_id", "message", "part", F.coalesce("role", F.lit("")).alias("role"), F.array_join(F.transform("last.texts", lambda t: t["text"]), "").alias("text"))
    whole = said.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("message", "part", "role", "text")), _by_message).alias("m"))
    return whole.select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))


def _compare(*pairs: tuple[Column, Column]) -> Column:
    out = F.lit(0)
    for a, b in reversed(pairs):
        out = F.when(a.eqNullSafe(b), out).when(a.isNull(), -1).when(b.isNull(), 1).when(a < b, -1).otherwise(1)
    return out


def _by_message(a: Column, b: Column) -> Column:
    return _compare((a["message"], b["message"]), (a["part"], b["part"]))


def render(turns: DataFrame, trained: tuple[str, ...] = TRAINED) -> DataFrame:
    """conv_id, formatted, loss_spans (start and length in code points, escaped text of trained roles)."""
    each = turns.select("conv_id", F.posexplode("turns").alias("at", "t"))
    each = each.select("conv_id", "at", F.concat(F.lit(OPEN), escape(F.col("t.role")), F.lit(MIDDLE)).alias("head"), escape(F.col("t.text")).alias("body"), F.col("t.role").isin(*trained).alias("loss"))
    n, before = F.length("body").cast("long"), W.partitionBy("conv_id").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length("head") + n + len(CLOSE)).over(before), F.lit(0)) + F.length("head")
    piece = F.struct("at", F.concat("head", "body", F.lit(CLOSE)).alias("piece"), F.struct(start.cast("long").alias("start"), n.alias("n")).alias("span"), "loss")
    whole = each.select("conv_id", piece.alias("p")).groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("p"))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("p", lambda x: x["piece"]), "").alias("formatted"),
        F.transform(F.filter("p", lambda x: x["loss"]), lambda x: x["span"]).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns, loss_text from the rendered text and its spans alone."""
    parts = F.split("formatted", r"</s>", -1)
    turns = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.split(p, r"\[/INST\]", 2))
    read = F.transform(turns, lambda t: F.struct(unescape(F.substring(t[0], F.lit(len(OPEN) + 1), F.length(t[0]))).alias("role"), unescape(t[1]).alias("text")))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["n"].cast("int")))), "")
    return formatted.select("conv_id", read.alias("turns"), loss.alias("loss_text"), "formatted")


def digests(read: DataFrame) -> DataFrame:
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
