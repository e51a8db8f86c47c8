"""Secrets in texts: fixed patterns, and values in credential contexts that are expensive to guess.

A value after a credential's name (``password: x``, ``"api_key" = "x"``, ``passphrase is x``, ``Bearer x``, ``//user:x@host``) is cut
into segments, each of which one of five kinds of guesser would try: words (of a short fixed list, and of the corpus by how often
they stand in it, also in other cases or with digits for letters), dates, repeated units, keyboard walks, and
brute force over the smallest fitting alphabet. Dynamic programming over the value's positions finds the segmentation that takes
the fewest guesses; the value is a secret if that number reaches LIMIT, in powers of ten. So random keys and odd passwords are
found, and prose, placeholders, dates and keyboard rows after the same names are left alone.

Word counts cover all texts. Only words that stand inside some value are kept: the values' substrings (as they stand, in lower
case with digits read as letters) are broadcast up to BROADCAST_WORDS of them, else joined; each value then meets its own words.

Spans are (kind, start, end) in code points, the end exclusive, of the whole match; of a value for kind ``guess``. A value inside a
span of a fixed pattern adds none, but its cost is given with that span.

Defined cases: a null text is empty and has no spans; ids may be null or repeated, every row has its own result; an empty table
gives an empty result; words count from 3 to 24 letters; values may have any length. Extra columns are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stage

# The patterns of the contract; the first one, as CONTEXT, for texts in lower case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # of a run of these letters the whole, so shorter matches need not be dropped
#: Kinds in the order of the contract; least length of a value, of an access key.
KINDS = ("assign", "access", "hex", "guess")
LEAST_VALUE, LEAST_ACCESS = 6, 20

#: A value in these contexts is judged by its cost. The shorter names stand at the start of a word only.
CONTEXT = re.compile(
    r"""(?:(?:password|passwd|passphrase|passcode|secret|token|credentials?|api[_\x20-]?key|access[_\x20-]?key|private[_\x20-]?key|client[_\x20-]?key"""
    r"""|(?<![a-z])(?:pwd|pass|pin|auth|authorization|login))["']?(?:\x20*(?:=>|:=|==?|:)\x20*|\x20+(?:is|was)\x20+)(?:bearer\x20+|basic\x20+)?|(?<![a-z])bearer\x20+|://[^\s/:@]*:(?=[^\s/@]+@))"""
    r"""(?:"([^"\n]+)"|'([^'\n]+)'|([^\s"'<>@][^\s"'<>]*))""",
    re.ASCII,
)
TRAILING = ".,;:!?)]}"

#: Powers of ten of guesses from which a value is a secret.
LIMIT = 8.0
WORD_LETTERS = (3, 24)
BROADCAST_WORDS = 500_000
#: Words of one task that are counted together before they are sent on.
COUNTED = 200_000
#: Longest unit of a repeat.
UNIT = 16

# Frequent words of passwords and placeholders, from the most to the less frequent.
COMMON = (
    "password qwerty admin welcome letmein monkey dragon master login iloveyou sunshine princess football baseball shadow superman "
    "batman trustno hello freedom whatever secret changeme default test guest root user example sample placeholder token pass "
    "none null true false required hidden redacted your here enter insert value string love hunter summer winter spring autumn "
    "january february march april june july august september october november december monday tuesday wednesday thursday friday "
    "saturday sunday company office server database access system computer internet service account"
).split()
#: Digits and signs read as letters.
LETTERS = str.maketrans("0134579@$!", "oleastgasi")
#: Rows of keys; the last one is the alphabet. Keys of neighbouring rows touch at the same place and the one before it.
ROWS = ("1234567890-=", "qwertyuiop[]", "asdfghjkl;'", "zxcvbnm,./", "", "abcdefghijklmnopqrstuvwxyz")
#: Alphabets of a brute-force span, each with the characters that it has.
ALPHABETS = tuple(
    (re.compile(p), math.log10(n))
    for p, n in (
        (r"[0-9]", 10), (r"[0-9a-f]", 16), (r"[a-z]", 26), (r"[A-Z]", 26), (r"[a-z0-9]", 36), (r"[A-Z0-9]", 36), (r"[A-Za-z]", 52), (r"[A-Za-z0-9]", 62), (r"[\x20-\x7e]", 95), (r"[\s\S]", 0x110000),
    )
)
#: A guesser has to try the kind of every segment; years and days that dates are tried for.
KIND, YEARS, DAYS = math.log10(5), 200, 365
DATE = re.compile(r"(\d{1,4})([-/._ ])(\d{1,2})\2(\d{1,4})|(?:19|20)\d\d(?!\d)", re.ASCII)


def _keys() -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {}
    for row, keys in enumerate(ROWS):
        for at, key in enumerate(keys):
            out.setdefault(key, []).append((row, at))
    return out


KEYS = _keys()
STEPS = {(0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1)}


def _steps(a: str, b: str) -> set[tuple[int, int]]:
    """Directions in which key b lies next to key a."""
    return {s for r, c in KEYS.get(a, ()) for x, y in KEYS.get(b, ()) if (s := (x - r, y - c)) in STEPS}


def is_day(digits: str) -> bool:
    """Six or eight digits that are a day in some usual order."""
    n = len(digits)
    for year, one, two in ((digits[n - 2 * (n // 4) :], digits[:2], digits[2:4]), (digits[: n - 4], digits[n - 4 : n - 2], digits[n - 2 :])):
        a, b = sorted((int(one), int(two)))
        if 1 <= a <= 12 and 1 <= b <= 31 and (len(year) == 2 or year[:2] in ("19", "20")):
            return True
    return False


class Guesser:
    """Least guesses for a value, as a power of ten; ``counts`` are the corpus words that may stand in it, ``total`` all of its words."""

    def __init__(self, counts: dict[str, int] | None = None, total: int = 0):
        self.words = {w: math.log10(max(1.0, total / n)) for w, n in (counts or {}).items() if w and n > 0}
        for rank, w in enumerate(COMMON, 1):
            self.words[w] = min(self.words.get(w, math.inf), math.log10(rank))
        self.longest = max(map(len, self.words))
        self.known: dict[str, float] = {}

    def cost(self, value: str) -> float:
        if value not in self.known:
            self.known[value] = self._cost(value)
        return self.known[value]

    def _cost(self, value: str) -> float:
        n = len(value)
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n)]  # of segments from a place: (end, cost)
        for find in (self._words, self._dates, self._repeats, self._walks):
            for start, end, cost in find(value):
                ends[start].append((end, cost))
        best = [math.inf] * (n + 1)
        best[0] = 0.0
        brute = [math.inf] * len(ALPHABETS)  # the cheapest that ends inside a brute-force span
        for at in range(n):
            if at:
                best[at] = min(best[at], *brute)
            here = best[at] + KIND
            for end, cost in ends[at]:
                best[end] = min(best[end], here + cost)
            brute = [min(here, b) + bits if letter.match(value[at]) else math.inf for b, (letter, bits) in zip(brute, ALPHABETS, strict=True)]
        return min(best[n], *brute) if n else 0.0

    def _words(self, value: str) -> Iterator[tuple[int, int, float]]:
        low = value.lower()
        if len(low) != len(value):  # a few letters grow in lower case
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
        read = low.translate(LETTERS)
        for i in range(len(value)):
            for j in range(i + WORD_LETTERS[0], min(len(value), i + self.longest) + 1):
                plain = low[i:j] == read[i:j]
                for text in (low[i:j],) if plain else (low[i:j], read[i:j]):
                    cost = self.words.get(text)
                    if cost is not None:
                        swapped = len({c for c, d in zip(low[i:j], text, strict=True) if c != d})
                        upper, letters = (sum(map(kind, value[i:j])) for kind in (str.isupper, str.isalpha))
                        yield i, j, cost + _cases(upper, letters, value[i].isupper()) + swapped * math.log10(2)

    def _dates(self, value: str) -> Iterator[tuple[int, int, float]]:
        for i, c in enumerate(value):
            if not ("0" <= c <= "9"):
                continue
            m = DATE.match(value, i)
            if m and m[2]:
                if is_day("".join(p.zfill(2) for p in (m[1], m[3], m[4]))[:8]) and {len(m[1]), len(m[4])} & {2, 4}:
                    yield i, m.end(), math.log10(YEARS * DAYS * 4)
            elif m:
                yield i, m.end(), math.log10(YEARS)
            for size in (6, 8):
                digits = value[i : i + size]
                if len(digits) == size and digits.isascii() and digits.isdigit() and is_day(digits):
                    yield i, i + size, math.log10(YEARS * DAYS)

    def _repeats(self, value: str) -> Iterator[tuple[int, int, float]]:
        n = len(value)
        for unit in range(1, min(UNIT, n // 2) + 1):
            same = 0  # characters from here on that equal the one a unit later
            for i in range(n - unit - 1, -1, -1):
                same = same + 1 if value[i] == value[i + unit] else 0
                times = same // unit + 1
                if times > 1 and times * unit > 2:
                    yield i, i + times * unit, self.cost(value[i : i + unit]) + math.log10(times)

    def _walks(self, value: str) -> Iterator[tuple[int, int, float]]:
        low = value.lower() if value.isascii() else "".join(c.lower() if c.isascii() else c for c in value)
        n = len(low)
        upper, letters = ([0, *accumulate(kind(c) for c in value)] for kind in (str.isupper, str.isalpha))
        end, turns, ways = n, 0, set()  # of the walk from a place: where it ends, its turns, the directions of its first step
        for i in range(n - 2, -1, -1):
            steps = _steps(low[i], low[i + 1])
            if not steps:
                end, turns, ways = i + 1, 0, set()
                continue
            if end <= i + 1 or not ways:
                end, turns, ways = max(end, i + 2), 1, steps
            elif steps & ways:
                ways = steps & ways
            else:
                turns, ways = turns + 1, steps
            if end - i > 2:
                yield i, end, math.log10(len(KEYS) * (end - i)) + (turns - 1) * math.log10(len(STEPS)) + _cases(upper[end] - upper[i], letters[end] - letters[i], value[i].isupper())


def _cases(upper: int, letters: int, first: bool) -> float:
    """Powers of ten of guesses for which letters are upper case; ``first``: the first one is."""
    if not upper:
        return 0.0
    if upper == letters or upper == 1 and first:
        return math.log10(2)
    fewer = min(upper, letters - upper)
    if letters > 60:
        return fewer * math.log10(letters / max(1, fewer)) + fewer * math.log10(math.e)
    return math.log10(1 + sum(math.comb(letters, k) for k in range(1, fewer + 1)))


def spans_of(text: str) -> list[tuple[str, int, int, str | None]]:
    """(kind, start, end, value): fixed patterns, and values in credential contexts that lie in none of them."""
    # two letters beyond ASCII have ASCII letters in lower case
    low = text.lower() if "\u212a" not in text and "\u0130" not in text else "".join(c.lower() if c.isascii() else c for c in text)
    found = [("assign", m.start(), m.end(), text[m.start(2) : m.end(2)]) for m in ASSIGN.finditer(low) if m.end(2) - m.start(2) >= LEAST_VALUE]
    found += [("access", m.start(), m.end(), None) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST_ACCESS]
    found += [("hex", m.start(), m.end(), None) for m in HEX.finditer(text)]
    fixed, reach = sorted((s, e) for _, s, e, _ in found), []
    for s, e in fixed:
        if not reach or e > reach[-1][1]:
            reach.append((s, e))
    at = 0
    for m in CONTEXT.finditer(low):
        group = m.lastindex
        start = m.start(group)
        value = text[start : m.end(group)]
        if group == 3:
            value = value.split("@", 1)[0] if "://" in m[0][: start - m.start()] else value.rstrip(TRAILING)
        end = start + len(value)
        while at < len(reach) and reach[at][1] < end:
            at += 1
        if value and not (at < len(reach) and reach[at][0] <= start):
            found.append(("guess", start, end, value))
    return sorted(found, key=lambda f: (f[1], KINDS.index(f[0])))


_FOUND = "array<struct<kind string, start long, end long, value string>>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())])


def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        found = [[dict(zip(("kind", "start", "end", "value"), f, strict=True)) for f in spans_of(t)] if t else [] for t in b.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(_SPAN))], ["doc_id", "found"])


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the texts with their counts; all of them together under the empty word."""
    counts: Counter[str] = Counter()
    letters = re.compile(rf"[^\W\d_]{{{WORD_LETTERS[0]},}}")

    def ship() -> pa.RecordBatch:
        counts[""] = counts.total()
        out = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        counts.clear()
        return out

    for b in slices(batches, "text"):
        for text in b.column(0).to_pylist():
            if text:
                counts.update(w for w in letters.findall(text.lower()) if len(w) <= WORD_LETTERS[1])
        if len(counts) > COUNTED:
            yield ship()
    yield ship()


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each value every run of letters of a word's length inside it, digits read as letters too."""
    for b in slices(batches, "value", 16 << 10):
        ids, words = [], []
        for i, value in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            own = set()
            for text in {(low := value.lower()), low.translate(LETTERS)}:
                for run in re.finditer(r"[^\W\d_]+", text):
                    for a in range(run.start(), run.end() - WORD_LETTERS[0] + 1):
                        own.update(text[a:z] for z in range(a + WORD_LETTERS[0], min(run.end(), a + WORD_LETTERS[1]) + 1))
            words += sorted(own)
            ids += [i] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(words, pa.string())], ["value_id", "word"])


def _costs(total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            costs = [Guesser({w["word"]: w["n"] for w in words or ()}, total).cost(v) for v, words in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(costs, pa.float64())], ["value", "cost"])

    return run


def guess_costs(values: DataFrame, texts: DataFrame) -> DataFrame:
    """(value, cost) of each distinct value, in powers of ten of guesses; ``texts`` holds the corpus whose words are tried."""
    once = stage(values.where("value is not null").select("value").distinct().withColumn("value_id", F.monotonically_increasing_id()), "secret-values")
    parts = stage(once.select("value_id", "value").mapInArrow(_parts, "value_id long, word string"), "secret-parts")
    wanted = stage(parts.select("word").union(once.sparkSession.range(1).select(F.lit("").alias("word"))).distinct(), "secret-words")
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_WORDS else wanted
    counted = texts.select("text").mapInArrow(_count, "word string, n long").join(wanted, "word", "left_semi").groupBy("word").agg(F.sum("n").alias("n"))
    counted = stage(counted, "secret-counts")
    total = counted.where("word = ''").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).head().n
    own = parts.join(counted, "word").groupBy("value_id").agg(F.collect_list(F.struct("word", "n")).alias("words"))
    return stage(once.join(own, "value_id", "left").select("value", "words").mapInArrow(_costs(total), "value string, cost double"), "secret-costs")


def scan(docs: DataFrame, limit: float = LIMIT) -> DataFrame:
    """(doc_id, spans) of every row: spans (start, order, end, kind, cost) by place, then in the order of KINDS."""
    found = docs.select("doc_id", "text").mapInArrow(_find, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, found {_FOUND}")
    found = stage(found.withColumn("row", F.monotonically_increasing_id()), "secret-found")
    hits = found.select("row", "doc_id", F.inline("found"))
    costs = guess_costs(hits.select("value"), docs).withColumnRenamed("value", "of")
    order = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    span = F.struct("start", order.alias("order"), "end", "kind", "cost")
    rows = hits.join(costs, F.col("value") == F.col("of"), "left").groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(span)).alias("spans"))
    kept = F.filter("spans", lambda s: (s["kind"] != "guess") | (s["cost"] >= limit))
    rows = rows.select("doc_id", kept.alias("spans"))
    return rows.unionByName(found.where(F.size("found") == 0).select("doc_id", F.array().cast(rows.schema["spans"].dataType).alias("spans")))
