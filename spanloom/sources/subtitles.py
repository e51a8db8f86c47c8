"""Subtitle files as cue tables, and cue tables as subtitle text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: The timing lines of SRT and WebVTT and the dialogue line of ASS.
TIMING = r"(?:(\d+):)?(\d{1,2}):(\d{2})[,.](\d{1,3})\s*-->\s*(?:(\d+):)?(\d{1,2}):(\d{2})[,.](\d{1,3})"
DIALOGUE = r"^Dialogue:\s*[^,]*,(\d+):(\d{2}):(\d{2})[.](\d{2}),(\d+):(\d{2}):(\d{2})[.](\d{2}),[^,]*,([^,]*),[^,]*,[^,]*,[^,]*,[^,]*,(.*)$"


def _number(text: Column) -> Column:
    return F.coalesce(F.when(text == "", None).otherwise(text).cast("double"), F.lit(0.0))


def _seconds(source: str, pattern: str, first: int, unit: int) -> Column:
    h, m, s, f = (_number(F.regexp_extract(source, pattern, first + i)) for i in range(4))
    return h * 3600 + m * 60 + s + f / unit


def read_cues(spark: SparkSession, path: str) -> DataFrame:
    """SRT or WebVTT files: media_id (file), number, t0, t1, text, in file order."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("media_id"), F.regexp_replace("value", "\r\n?", "\n").alias("v"))
    blocks = files.select("media_id", F.posexplode(F.split("v", r"\n[ \t]*\n\s*")).alias("place", "block")).where(F.col("block").rlike(TIMING))
    body = F.regexp_replace(F.regexp_replace(F.substring_index("block", "-->", -1), r"^[^\n]*\n?", ""), r"^\s+|\s+$", "")
    rows = blocks.select("media_id", "place", _seconds("block", TIMING, 1, 1000).alias("t0"), _seconds("block", TIMING, 5, 1000).alias("t1"), body.alias("text"))
    return rows.where("t1 >= t0").select("media_id", "place", "t0", "t1", "text")


def read_ass(spark: SparkSession, path: str) -> DataFrame:
    """ASS files: media_id, t0, t1, speaker, text without override tags."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("media_id"), "value").where(F.col("value").rlike(DIALOGUE))
    text = F.regexp_replace(F.regexp_replace(F.regexp_extract("value", DIALOGUE, 10), r"\{[^}]*\}", ""), r"\\[Nn]", "\n")
    speaker = F.nullif(F.trim(F.regexp_extract("value", DIALOGUE, 9)), F.lit(""))
    return lines.select("media_id", _seconds("value", DIALOGUE, 1, 100).alias("t0"), _seconds("value", DIALOGUE, 5, 100).alias("t1"), speaker.alias("speaker"), text.alias("text"))


def clock(seconds: Column, mark: str) -> Column:
    """HH:MM:SS and milliseconds after ``mark``."""
    ms = F.round(seconds * 1000).cast("long")
    return F.format_string(f"%02d:%02d:%02d{mark}%03d", F.floor(ms / 3_600_000), F.pmod(F.floor(ms / 60_000), F.lit(60)), F.pmod(F.floor(ms / 1000), F.lit(60)), F.pmod(ms, F.lit(1000)))


def to_srt(cues: DataFrame) -> DataFrame:
    """media_id and the file's text; a media's cues are one file and so one row."""
    item = F.struct("t0", "t1", "text")
    ordered = cues.groupBy("media_id").agg(F.array_sort(F.collect_list(item)).alias("c"))
    block = F.transform("c", lambda c, i: F.concat_ws("\n", (i + 1).cast("string"), F.concat(clock(c["t0"], ","), F.lit(" --> "), clock(c["t1"], ",")), c["text"]))
    return ordered.select("media_id", F.concat(F.array_join(block, "\n\n"), F.lit("\n")).alias("srt"))


def _stamp(seconds: Column, unit: int) -> Column:
    """Whole units of time, rounded half up and at least one."""
    return F.greatest(F.lit(1), F.floor(seconds * unit + 0.5)).cast("long")


def to_vtt(cues: DataFrame) -> DataFrame:
    """media_id and the file's text; a speaker is put before the text."""
    ordered = cues.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("t0", "t1", "speaker", "text"))).alias("c"))
    said = lambda c: F.concat(F.when(c["speaker"].isNull(), "").otherwise(F.concat(F.lit("["), c["speaker"], F.lit("] "))), c["text"])
    block = F.transform("c", lambda c: F.concat_ws("\n", F.concat(clock(c["t0"], "."), F.lit(" --> "), clock(c["t1"], ".")), said(c)))
    return ordered.select("media_id", F.concat(F.lit("WEBVTT\n\n"), F.array_join(block, "\n\n"), F.lit("\n")).alias("vtt"))


#: The head of an ASS file.
ASS_HEAD = """[Script Info]
ScriptType: v4.00+

[V4+ Styles]
Format: Name, Fontname, Fontsize
Style: Default,Arial,20

[Events]
Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text
"""


def to_ass(cues: DataFrame) -> DataFrame:
    """media_id and the file's text; the speaker is the name of the line."""

    def at(seconds: Column) -> Column:
        cs = _stamp(seconds, 100)
        return F.format_string("%d:%02d:%02d.%02d", F.floor(cs / 360_000), F.pmod(F.floor(cs / 6000), F.lit(60)), F.pmod(F.floor(cs / 100), F.lit(60)), F.pmod(cs, F.lit(100)))

    ordered = cues.groupBy("media_id").agg(F.array_sort(F.collect_list(F.struct("t0", "t1", "speaker", "text"))).alias("c"))
    name = lambda c: F.regexp_replace(F.coalesce(c["speaker"], F.lit("")), ",", " ")
    line = F.transform("c", lambda c: F.concat(F.lit("Dialogue: 0,"), at(c["t0"]), F.lit(","), at(c["t1"]), F.lit(",Default,"), name(c), F.lit(",0,0,0,,"), F.regexp_replace(c["text"], "\n", r"\\N")))
    return ordered.select("media_id", F.concat(F.lit(ASS_HEAD), F.array_join(line, "\n"), F.lit("\n")).alias("ass"))


WORDS = "words array<struct<id:string,text:string,speaker:string,onset:double,offset:double>>"


def read_words(spark: SparkSession, path: str) -> DataFrame:
    """Gold words of JSON files: media_id, id, text, speaker, onset, offset; a broken file or word fails the read."""
    files = spark.read.schema(WORDS).option("mode", "FAILFAST").option("multiLine", True).json(path)
    w = files.select(F.col("_metadata.file_path").alias("media_id"), F.inline("words"))
    n = F.count(F.lit(1)).over(W.partitionBy("media_id", "id"))
    fault = (
        F.when(F.col("id").isNull() | (n > 1), "repeated or missing id").when(F.coalesce(F.trim("text"), F.lit("")) == "", "no text")
        .when(F.col("speaker").isNull(), "no speaker").when(F.coalesce((F.col("onset") < 0) | (F.col("onset") >= F.col("offset")), F.lit(True)), "times out of order")
    )
    checked = w.withColumn("_f", fault).withColumn("id", F.when(F.col("_f").isNull(), F.col("id")).otherwise(F.raise_error(F.concat(F.lit("word "), F.coalesce("id", F.lit("?")), F.lit(": "), "_f"))))
    return checked.drop("_f")
