"""Long cues cut into readable ones: utterances, their times from words, groups of them, and cuts at weak separators.

Cues are independent rows: Spark finds their utterances and tokens, small loops over Arrow batches match and cut one cue at a time, and
no shuffle is needed before cues are numbered.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.events import room
from ..functions.text import display_chars

#: Marks that end an utterance, abbreviations that do not, separators of forced cuts, marks beside a word.
MARKS = ".!?！？。"
ABBREVIATIONS = "dr mr mrs ms prof st jr sr etc vs inc ltd co dept est approx esp eg ie".split()
#: White space as Spark's regular expressions know it, and what separates weakly.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WEAK = f",，;；—…{WHITE}"
WEAK_PARTS = re.compile(f"([{WEAK}]+)")
BESIDE = ".,!?;:，。！？；：\"'"

WORD = "struct<text:string,start:double,end:double>"


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: Spark would compute a column anew for each of its uses inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _shown(text: str) -> int:
    """Characters as ``display_chars`` counts them."""
    return len(text) - text.count(" ") - text.count("\n")


def utterances(text: Column) -> Column:
    """Texts that end with one mark each; a piece after an abbreviation belongs to it."""
    raw = F.filter(F.transform(F.regexp_extract_all(text, F.lit(f"[^{MARKS}]*[{MARKS}]|[^{MARKS}]+$"), F.lit(0)), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")), lambda p: p != "")
    short = lambda p: F.lower(F.regexp_replace(F.regexp_extract(p, r"(?U)(\S+)$", 1), f"[{MARKS}]+$", "")).isin(ABBREVIATIONS)

    def add(out: Column, p: Column) -> Column:
        prev = F.element_at(out, -1)
        return F.when(short(prev), F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(F.concat_ws(" ", prev, p)))).otherwise(F.concat(out, F.array(p)))

    folded = lambda raw: F.aggregate(raw, F.array().cast("array<string>"), lambda out, p: F.when(F.size(out) == 0, F.array(p)).otherwise(add(out, p)))
    # a fold is slow, and few texts need one
    return _let(raw, lambda raw: F.when(F.exists(raw, short), folded(raw)).otherwise(raw))


def _later(a: float | None, b: float | None) -> float | None:
    """The larger time; a missing one does not count."""
    return b if a is None else a if b is None else max(a, b)


def _sooner(a: float | None, b: float | None) -> float | None:
    return b if a is None else a if b is None else min(a, b)


def match_words(tokens: list[str], tried: list[int], bare: list[str | None]) -> list[int]:
    """Those of the ``tried`` words that stand for ``tokens``, in order: each token takes the next word that equals, holds or is held by it.

    Tokens without one are passed over.
    """
    out, next_ = [], 0
    for token in tokens:
        for k in range(next_, len(tried)):
            b = bare[tried[k]]
            if b is not None and (token in b or b in token):
                out.append(tried[k])
                next_ = k + 1
                break
    return out


def timed(sizes: list[int], tokens: list[list[str]], chars: int, t0: float | None, t1: float | None, starts: np.ndarray, ends: np.ndarray, bare: list[str | None]) -> list[tuple]:
    """Utterances as (start, end, places of words): times of their first and last word, else by their share of the characters.

    Only words within the estimated time, widened by half of it on both sides, are tried.
    """
    out, at, total, known = [], 0, max(1, chars), t0 is not None and t1 is not None
    moment = lambda place, own: None if np.isnan(own[place]) else t0 + float(own[place])
    for n, some in zip(sizes, tokens, strict=True):
        upto, mine, a, z = at + n, [], None, None
        if known:
            a, z = at / total * (t1 - t0), upto / total * (t1 - t0)
            margin = (z - a) * 0.5
            mine = match_words(some, np.flatnonzero((starts >= a - margin) & (ends <= z + margin)).tolist(), bare)
        if mine:
            out.append((moment(mine[0], starts), moment(mine[-1], ends), mine))
        else:
            out.append((_later(t0, t0 + a if known else None), _sooner(t1, t0 + z if known else None), mine))
        at = upto
    return out


def grouped(pieces: list[tuple], shortest: float, longest: float) -> list[tuple[int, int, bool]]:
    """Consecutive pieces as (first, end, forced): one by one, but a short one takes the next ones until it is long enough or would be too long.

    A piece over ``longest`` is ``forced``: it has to be cut further.
    """
    out, i = [], 0
    length = lambda a, z: None if a is None or z is None else z - a
    while i < len(pieces):
        start, first = pieces[i][0], i
        long = length(start, pieces[i][1])
        i += 1
        if long is not None and long > longest:
            out.append((first, i, True))
            continue
        if long is not None and long < shortest:
            while i < len(pieces):
                long = length(start, pieces[i][1])
                if long is not None and long > longest:
                    break
                i += 1
                if long is not None and long >= shortest:
                    break
        out.append((first, i, False))
    return out


def forced(text: str, chars: int, target: int, t0: float | None, t1: float | None, own: Sequence[int], starts: np.ndarray, ends: np.ndarray) -> list[tuple]:
    """Cuts at weak separators once ``target`` characters are reached, as (text, start, end, places of words); times by the share of the characters.

    Separators inside a cut have no length of their own. A rest of four characters or less, or under a quarter of all, joins the last cut.
    """
    total, known = max(1, chars), t0 is not None and t1 is not None
    share = lambda n: n / total * (t1 - t0) if known else None
    when = lambda n: t0 + share(n) if known else None
    own = np.asarray(own, np.int64)
    begin, stop = starts[own], ends[own]
    out, now, at, since = [], [], 0, 0
    parts = WEAK_PARTS.split(text)  # words, each but the last with the separator after it
    for k, p in enumerate(parts):
        if not p:  # before a leading separator or after the last one
            continue
        if k % 2:
            if now:
                now.append(p)
                continue
            at += _shown(p)
            if out:
                out[-1] = (out[-1][0].rstrip(WHITE) + p, out[-1][1], when(at), out[-1][3])
            since = at
            continue
        now.append(p)
        at += len(p)
        if at - since >= target or at >= total:
            inside = own[(begin >= share(since)) & (stop <= share(at) + 0.001)].tolist() if known else []
            out.append(("".join(now).strip(WHITE), _later(t0, when(since)), _sooner(t1, when(at)), inside))
            now, since = [], at
    rest = "".join(now).strip(WHITE)
    n = _shown(rest)
    if rest and out and (n <= 4 or n / total < 0.25):
        out[-1] = (out[-1][0].rstrip(WHITE) + " " + rest, out[-1][1], t1, out[-1][3])
    elif rest:
        out.append((rest, out[-1][2] if out else t0, t1, []))
    return out or [(text, t0, t1, own.tolist())]


def _rows(lists: pa.Array, values: np.ndarray | list) -> Iterator:
    """The part of each row in the ``values`` of all."""
    at = lists.offsets.to_pylist()
    return (values[a:z] for a, z in zip(at[:-1], at[1:], strict=True))


def _cutter(shortest: float, longest: float) -> Callable:
    """Cues as lists of (text, start, end, places of words); no such piece of cues without ``parts``, which stay whole."""

    def cut(text: pa.Array, chars: pa.Array, half: pa.Array, t0: pa.Array, t1: pa.Array, starts: pa.Array, ends: pa.Array, bare: pa.Array, parts: pa.Array) -> pa.Array:
        plain = [x.to_pylist() for x in (text, chars, half, t0, t1)]
        times = [_rows(x, x.values.to_numpy(zero_copy_only=False)) for x in (starts, ends)]
        texts, sizes, halves, tokens = (parts.values.field(k) for k in range(4))
        tokens = list(_rows(tokens, tokens.values.to_pylist()))
        owned = [_rows(parts, x) for x in (texts.to_pylist(), sizes.to_pylist(), halves.to_pylist(), tokens)]
        pieces, upto = [], [0]
        for over, s, n, h, a, z, w0, w1, words, own, size, room_, said in zip(parts.is_valid().to_pylist(), *plain, *times, _rows(bare, bare.values.to_pylist()), *owned, strict=True):
            if over and len(own) < 2:
                pieces += forced(s, n, h, a, z, range(len(words)), w0, w1)
            elif over:
                of = timed(size, said, n, a, z, w0, w1, words)
                for first, end, long in grouped(of, shortest, longest):
                    if long:
                        start, stop, mine = of[first]
                        pieces += forced(own[first], size[first], room_[first], start, stop, mine, w0, w1)
                    else:
                        pieces.append((" ".join(own[first:end]), of[first][0], of[end - 1][1], [k for x in of[first:end] for k in x[2]]))
            upto.append(len(pieces))
        columns = list(zip(*pieces, strict=True)) or [()] * 4
        places = pa.ListArray.from_arrays(pa.array(np.cumsum([0] + [len(x) for x in columns[3]]), pa.int32()), pa.array([k for x in columns[3] for k in x], pa.int32()))
        cuts = pa.StructArray.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.float64()), places], ["text", "start", "end", "at"])
        return pa.ListArray.from_arrays(pa.array(upto, pa.int32()), cuts)

    return cut


def split_long(cues: DataFrame, by: Sequence[str], shortest: float = 0.8, longest: float = 5.0, lines: int = 2, cjk: int = 20, latin: int = 42) -> DataFrame:
    """Cues (id, t0, t1, text, words) with those cut that last over ``longest`` or hold more characters than ``lines`` lines of their script.

    A cue goes by its utterances; one without two of them, and an utterance over ``longest``, is cut at weak separators after half its room.
    ``words`` are struct<text, start, end> within the cue. Returns by, cue (numbered from 1 by place), id, t0, t1, text, words.
    """
    some = cues.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("words", F.coalesce(F.col("words").cast(f"array<{WORD}>"), F.array().cast(f"array<{WORD}>")))
    half = lambda text: F.floor(room(text, lines, cjk, latin) / 2)
    some = some.withColumn("_chars", display_chars("text"))
    over = ~((F.col("t1") - F.col("t0") <= longest) & (F.col("_chars") <= room(F.col("text"), lines, cjk, latin)))
    tokens = lambda p: F.regexp_extract_all(F.lower(p), F.lit(r"(?U)[\w']+"), F.lit(0))
    parts = F.transform(utterances(F.col("text")), lambda p: F.struct(p.alias("text"), display_chars(p).alias("n"), half(p).alias("half"), tokens(p).alias("tokens")))
    bare = lambda w: F.lower(F.btrim(w["text"], F.lit(BESIDE)))
    lists = [F.transform("words", f) for f in (lambda w: w["start"], lambda w: w["end"], bare)]
    cut = F.arrow_udf(_cutter(shortest, longest), "array<struct<text:string,start:double,end:double,at:array<int>>>")
    some = some.withColumn("_cut", cut("text", "_chars", half(F.col("text")), F.col("t0").cast("double"), F.col("t1").cast("double"), *lists, F.when(over, parts)))
    # a word is taken by its place, so it comes back as it was
    taken = F.transform("_cut", lambda c: F.struct(c["text"], c["start"], c["end"], F.transform(c["at"], lambda k: F.get("words", k)).alias("words")))
    whole = F.array(F.struct("text", F.col("t0").cast("double").alias("start"), F.col("t1").cast("double").alias("end"), "words"))
    # the outer form, as Spark would compute the cuts twice to filter out empty lists, which there are none of
    rows = some.withColumn("_all", F.when(F.size("_cut") > 0, taken).otherwise(whole)).select(*by, "id", F.col("_all")[0]["start"].alias("_at"), F.posexplode_outer("_all").alias("_p", "_c"))
    rows = rows.select(*by, "id", "_at", "_p", F.col("_c.text").alias("text"), F.col("_c.start").alias("t0"), F.col("_c.end").alias("t1"), F.col("_c.words").alias("words"))
    place = W.partitionBy(*by).orderBy("_at", "id", "_p")
    return rows.withColumn("cue", F.row_number().over(place)).select(*by, "cue", "id", "t0", "t1", "text", "words")
