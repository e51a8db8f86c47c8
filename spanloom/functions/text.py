"""Scalar text functions as column expressions."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Marks that end a sentence, and soft pauses.
SENTENCE_END = r"[.!?。！？…]\s*$"
SOFT_PAUSE = r"[,;:，；：、]\s*$"


def squeeze(text: Column) -> Column:
    """Lower case, white space runs as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def words(text: Column) -> Column:
    """Distinct words of a-z, sorted."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]+"), F.lit(0))))


def jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / both)


def ends_sentence(text: Column) -> Column:
    return text.rlike(SENTENCE_END)


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance over the longer length."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


#: Scripts written without spaces between words, and han, kana and hangul alone.
NO_SPACE = r"[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}\x{0E80}-\x{0EFF}\x{0E00}-\x{0E7F}\x{1000}-\x{109F}\x{1780}-\x{17FF}\x{0900}-\x{0DFF}]"
CJK = r"[\x{4E00}-\x{9FFF}\x{3040}-\x{30FF}\x{AC00}-\x{D7AF}]"
#: Phrases that recognisers repeat from their training texts.
TRAINING_PHRASES = ("字幕志愿者", "中文字幕志愿者", "感谢观看", "感谢收看", "thanks for watching")
#: Closing marks that take no space before, opening marks that take none after.
CLOSING, OPENING = "，。！？；：、,.!?;:)]}）】》”’\"", "([{（【《“‘"


def count_matches(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def display_chars(text: Column) -> Column:
    """Characters without spaces and line breaks."""
    return F.length(F.regexp_replace(text, r"[ \n]", ""))


def count_words(text: Column) -> Column:
    """Words between white space, and every character of a script without spaces; 0 for null."""
    rest = F.regexp_replace(text, NO_SPACE, " ")
    return F.coalesce(count_matches(text, NO_SPACE) + count_matches(rest, r"\S+"), F.lit(0))


def script(text: Column) -> Column:
    """cjk or latin, whichever has more letters (cjk at a tie above zero), else other."""
    c, latin = count_matches(text, CJK), count_matches(text, "[A-Za-z]")
    return F.when((c == 0) & (latin == 0), "other").when(c >= latin, "cjk").otherwise("latin")


def numbers(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))


def utterances(text: Column) -> Column:
    """Pieces that end with sentence marks, trimmed; the rest is the last piece."""
    return F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"[^.!?。！？]*[.!?。！？]+|[^.!?。！？]+$"), F.lit(0)), lambda x: F.trim(x)), lambda x: x != "")


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9]+|[\x{4E00}-\x{9FFF}]"), F.lit(0))


def repeats_token(text: Column) -> Column:
    """Whether some token follows itself."""
    t = tokens(text)
    return F.exists(F.arrays_zip(F.slice(t, 1, F.greatest(F.size(t) - 1, F.lit(0))).alias("a"), F.slice(t, 2, F.greatest(F.size(t) - 1, F.lit(0))).alias("b")), lambda p: p["a"] == p["b"])


def letters(number: Column) -> Column:
    """0 is A, 25 Z, 26 AA, 27 BB."""
    return F.repeat(F.char(F.lit(65) + number % 26), F.floor(number / 26).cast("int") + 1)


def wrap_middle(text: Column, most: int, reach: int = 10) -> Column:
    """Break a line longer than ``most`` at the space or mark nearest its middle, within ``reach``; else at the middle."""
    mid = F.floor(F.length(text) / 2).cast("int")
    # candidates from the middle outwards, the right one first at each distance
    around = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(reach)), lambda i: F.array(mid + i, mid - i)))
    fits = F.filter(around, lambda p: (p > 0) & (p < F.length(text)) & F.substring(text, p, F.lit(1)).rlike(r"[ ,.!?;:，。！？；：、]"))
    at = F.coalesce(F.get(fits, F.lit(0)), mid)
    return F.when(F.length(text) <= most, text).otherwise(F.concat_ws("\n", F.rtrim(F.substring(text, F.lit(1), at)), F.ltrim(F.substring(text, at + 1, F.length(text)))))


def join_tokens(words: Column) -> Column:
    """Words as one text, spaced except beside marks and characters of scripts without spaces."""
    tight_left, tight_right = ("[" + CJK[1:-1] + "".join("\\" + c for c in marks) + "]" for marks in (CLOSING, OPENING))

    def add(acc: Column, w: Column) -> Column:
        glued = F.substring(w, 1, 1).rlike(tight_left) | F.right(acc, F.lit(1)).rlike(tight_right)
        return F.when(w == "", acc).when(acc == "", w).when(glued, F.concat(acc, w)).otherwise(F.concat_ws(" ", acc, w))

    return F.aggregate(F.transform(words, lambda w: F.trim(w)), F.lit(""), add)


def edit_class(a: Column, b: Column) -> Column:
    """same, punctuation (equal without marks, spaces and case), rewording (similarity above one half) or other."""
    bare = lambda t: F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}]", "")
    return F.when(a == b, "same").when(bare(a) == bare(b), "punctuation").when(similarity(a, b) > 0.5, "rewording").otherwise("other")


def long_similarity(a: Column, b: Column, most: int = 200) -> Column:
    """Edit similarity; above ``most`` characters the Jaccard share of their character sets; 1 if both are empty, 0 if one is."""
    chars = lambda t: F.array_distinct(F.filter(F.split(t, ""), lambda c: c != ""))
    return F.when((a == "") & (b == ""), F.lit(1.0)).when((a == "") | (b == ""), F.lit(0.0)).when(F.greatest(F.length(a), F.length(b)) > most, jaccard(chars(a), chars(b))).otherwise(similarity(a, b))


def segment_fault(text: Column, no_speech: Column, logprob: Column, compression: Column) -> Column:
    """Why a recognised segment is dropped, or null; missing measures are passed over."""
    bare = F.regexp_replace(F.lower(text), r"[\s\p{P}]", "")
    phrases = [p.replace(" ", "") for p in TRAINING_PHRASES]
    return (
        F.when(bare == "", "empty").when(bare.isin(phrases), "training phrase").when((no_speech >= 0.6) & (logprob < -1.0), "no speech")
        .when((compression > 2.4) & repeats_token(text), "repetition")
    )


#: Number words with the list numbers they stand for, marks beside words, spellings that recognisers get wrong.
NUMBER_WORDS = {w: f"{i}." for i, w in enumerate("one two three four five six seven eight nine ten".split(), 1)}
BESIDE_WORDS = ".,!?;:，。！？；："
SPELLINGS = {"mahood": "Mehood", "lusty": "Lestie", "lesti": "Lestie", "suzy": "Susie", "shao shi": "Xiao Xi"}


def _lookup(pairs: Mapping[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for p in pairs.items() for x in p]), key)


def numbered(text: Column) -> Column:
    """A leading number word as a list number: before a capital or in six words at most, or alone; else the text as it is."""
    word = F.regexp_extract(text, rf"(?iU)^({'|'.join(NUMBER_WORDS)})\s+\w", 1)
    rest = F.regexp_replace(F.substring(text, F.length(word) + 1, F.length(text)), r"(?U)^\s+|\s+$", "")
    few = F.size(F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0)))
    bare = F.regexp_replace(text, f"[{BESIDE_WORDS}]+$", "")
    alone = _lookup(NUMBER_WORDS, F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), f"[{BESIDE_WORDS}]+$", ""), r"(?U)^\s+", "")))
    listed = (word != "") & (rest.rlike(r"^\p{Lu}") | (few <= 6))
    return F.when(listed, F.concat_ws(" ", _lookup(NUMBER_WORDS, F.lower(word)), rest)).when(alone.isNotNull() & (few == 1), F.concat(alone, F.substring(text, F.length(bare) + 1, F.length(text)))).otherwise(text)


def corrected(text: Column, spellings: Mapping[str, str]) -> Column:
    """Known wrong spellings replaced: phrases anywhere (those of most words first), then words, which keep their case and the marks after them."""
    for phrase in sorted((k for k in spellings if " " in k), key=lambda k: -len(k.split())):
        text = F.regexp_replace(text, "(?iu)" + re.escape(phrase), spellings[phrase].replace("\\", "\\\\").replace("$", "\\$"))

    def word(w: Column) -> Column:
        right = _lookup(spellings, F.lower(F.btrim(w, F.lit(BESIDE_WORDS))))
        upper = w.rlike(r"\p{Lu}") & ~w.rlike(r"\p{Ll}")
        cased = F.when(upper, F.upper(right)).when(w.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(right, 1, 1)), F.substring(right, F.lit(2), F.length(right)))).otherwise(right)
        return F.when(right.isNull(), w).otherwise(F.concat(cased, F.regexp_extract(w, f"([{BESIDE_WORDS}]*)$", 1)))

    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0)), word), " ")


def normalized(text: Column, spellings: Mapping[str, str] = SPELLINGS) -> Column:
    """A recognised text with list numbers, known spellings, a final stop after a letter or digit, and single spaces; blank texts as they are."""
    fixed = corrected(numbered(text), spellings) if spellings else F.array_join(F.regexp_extract_all(numbered(text), F.lit(r"(?U)\S+"), F.lit(0)), " ")
    return F.when(text.rlike(r"(?U)\S"), F.when(fixed.rlike(r"[\p{L}\p{N}]$"), F.concat(fixed, F.lit("."))).otherwise(fixed)).otherwise(text)
