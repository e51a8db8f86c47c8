"""Language identification by a linear-chain conditional random field over words.

A word's emission is the mean of learned weights of its character n-grams (2 to 4 letters, the word's
ends included, so prefixes and suffixes are among them) plus a lexicon weight of the whole word. With
learned transitions, forward-backward labels every word, so code-switched text gets a label per word.
A document's language is the one with the largest letter-weighted sum of marginals; its share is the score.

Training sees text and language of rows outside the held-out fold only: for every language the SAMPLE
rows whose id has the smallest hash, of at most SAMPLE_BYTES bytes each. Stretches of 8 to 60 words of
different rows are strung together, so that transitions between languages are learned too.
Prediction sees whole texts and nothing else.

Defined cases: null texts and texts without a letter are `und` with score 0; without training rows
every text is `und`; a null language is not learned; a null id predicts like any other; repeated
rows predict alike; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .chars import code_points, lower_letters
from .common import crc32_mod, slices, stage
from .crf import Adam, Chains, forward_backward, gold_counts

FOLDS, HELD_OUT = 4, 2
SAMPLE = 160
SAMPLE_BYTES = 1 << 14
#: Languages that a model tells apart, at most: with more, the sample is the first rows of the languages that come first by name.
MAX_LANGUAGES = 512
#: Slots of each table of hashed weights.
SLOTS = 1 << 16
ROUNDS = 40


@dataclass
class Words:
    """Words of several texts: hashed n-grams of each letter, and where words and texts begin."""

    grams: list[np.ndarray]  # slots of the 2-, 3- and 4-grams around each letter
    starts: np.ndarray  # first letter of each word
    sizes: np.ndarray  # letters of each word
    lexicon: np.ndarray  # slot of each word
    counts: np.ndarray  # words of each text


def _slot(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint32(15))
    return ((h * np.uint32(2246822519)) >> np.uint32(16)).astype(np.int64)


def words_of(texts: list[str | None]) -> Words:
    points = [code_points(t or "") for t in texts]
    lengths = np.array([len(p) + 2 for p in points], np.int64)
    gap = np.zeros(1, np.uint32)
    c = lower_letters(np.concatenate([x for p in points for x in (gap, p, gap)] + [np.zeros(3, np.uint32)]))
    at = np.flatnonzero(c)
    a, b = np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B)
    z, y, x, w = c[at - 1], c[at], c[at + 1], c[at + 2]
    two = (y * a + x) * b + np.uint32(97)
    three = (z * a + y) * a + x
    # past the end of a word nothing counts
    four = three * b + np.where(x > 0, w, 0)
    grams = [_slot(two), _slot(three), _slot(four)]
    new = c[at - 1] == 0
    starts = np.flatnonzero(new)
    sizes = np.diff([*starts, len(at)])
    place = np.arange(len(at)) - np.repeat(starts, sizes)
    mixed = (y + np.uint32(1)) * a ^ (place.astype(np.uint32) * np.uint32(40503))
    code = np.add.reduceat(mixed * b, starts, dtype=np.uint32) if len(starts) else np.zeros(0, np.uint32)
    text = np.repeat(np.arange(len(texts)), lengths)
    counts = np.bincount(text[at[starts]], minlength=len(texts)) if len(starts) else np.zeros(len(texts), np.int64)
    return Words(grams, starts, sizes, _slot(code), counts)


class WordField:
    """The trained field over words."""

    def __init__(self, names: list[str]):
        k = len(names)
        self.names = names
        self.tables = [np.zeros((SLOTS, k), np.float32) for _ in range(4)]  # 2-, 3-, 4-grams, lexicon
        self.move, self.begin = np.zeros((k, k), np.float32), np.zeros(k, np.float32)

    def emission(self, w: Words) -> np.ndarray:
        if not len(w.starts):
            return np.zeros((0, len(self.names)), np.float32)
        rows = self.tables[0][w.grams[0]]
        for table, grams in zip(self.tables[1:-1], w.grams[1:], strict=True):
            rows += table[grams]
        return np.add.reduceat(rows, w.starts, axis=0) / w.sizes[:, None].astype(np.float32) + self.tables[-1][w.lexicon]

    def train(self, w: Words, labels: np.ndarray, lengths: np.ndarray, rounds: int = ROUNDS) -> None:
        k, n = len(self.names), len(labels)
        chains = Chains.of(lengths)
        hot, moves, firsts = gold_counts(labels, lengths, k)
        adam = Adam(0.1)
        word = np.repeat(np.arange(n), w.sizes)
        for _ in range(rounds):
            post, seen, begun, _ = forward_backward(self.emission(w).astype(np.float64), chains, self.move.astype(np.float64), self.begin.astype(np.float64), pairs=True)
            adam.begin()
            error = hot - post
            spread = (error / w.sizes[:, None])[word]
            for i, slot in enumerate([*w.grams, w.lexicon]):
                weight = spread if i < len(w.grams) else error
                grad = np.column_stack([np.bincount(slot, weights=weight[:, j], minlength=SLOTS) for j in range(k)]).astype(np.float32)
                adam.step(f"t{i}", self.tables[i], grad / n - 1e-6 * self.tables[i])
            adam.step("move", self.move, ((moves - seen) / n - 1e-5 * self.move).astype(np.float32))
            adam.step("begin", self.begin, ((firsts - begun) / len(lengths) - 1e-3 * self.begin).astype(np.float32))

    def word_marginals(self, texts: list[str | None]) -> tuple[Words, np.ndarray]:
        w = words_of(texts)
        post, _, _, _ = forward_backward(self.emission(w), Chains.of(w.counts), self.move, self.begin)
        return w, post

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        w, post = self.word_marginals(texts)
        text = np.repeat(np.arange(len(texts)), w.counts)
        mass = np.column_stack([np.bincount(text, weights=post[:, j] * w.sizes, minlength=len(texts)) for j in range(len(self.names))])
        total = mass.sum(axis=1)
        best = mass.argmax(axis=1)
        share = mass[np.arange(len(texts)), best] / np.maximum(total, 1e-12)
        names = [self.names[b] if t > 0 else "und" for b, t in zip(best.tolist(), total.tolist(), strict=True)]
        return names, np.where(total > 0, np.clip(share, 0, 1), 0.0)


def _strung(words: Words, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the words and sequence lengths: stretches of different texts one after another."""
    rng = np.random.default_rng(17)
    pieces, first = [], 0
    for n in words.counts.tolist():
        at = first
        while at < first + n:
            size = int(rng.integers(8, 61))
            pieces.append((at, min(first + n, at + size)))
            at += size
        first += n
    rng.shuffle(pieces)
    order = np.concatenate([np.arange(a, b) for a, b in pieces]) if pieces else np.zeros(0, np.int64)
    sizes = np.array([b - a for a, b in pieces], np.int64)
    return order, np.add.reduceat(sizes, np.arange(0, len(sizes), 6)) if len(sizes) else sizes


def _picked(w: Words, order: np.ndarray) -> Words:
    """The words of ``w`` in another order, as one text."""
    sizes = w.sizes[order]
    starts = np.cumsum(sizes) - sizes
    letters = np.repeat(w.starts[order] - starts, sizes) + np.arange(int(sizes.sum()))
    return Words([g[letters] for g in w.grams], starts, sizes, w.lexicon[order], np.array([len(order)]))


def fit(docs: DataFrame, sample: int = SAMPLE) -> WordField | None:
    """Train on the bounded sample; None if no row may be learned from."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.octet_length("text") <= SAMPLE_BYTES) & (crc32_mod(F.col("doc_id"), FOLDS) != HELD_OUT))
    coded = known.select("doc_id", F.col("lang").cast("string").alias("lang"), F.xxhash64("text").alias("code"), "text")
    key = F.col("doc_id").cast("string")
    first = F.row_number().over(W.partitionBy("lang").orderBy(F.xxhash64(key), key, "code"))
    picked = coded.select("doc_id", "lang", "code").distinct().withColumn("_r", first).where(F.col("_r") <= sample)
    chosen = stage(picked.orderBy("_r", "lang").limit(MAX_LANGUAGES * sample).select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang"), F.col("code").alias("_code")), "language-sample")
    # MAX_LANGUAGES * sample rows at most; a chosen row that is repeated is read once
    met = coded.join(F.broadcast(chosen), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang")) & (F.col("code") == F.col("_code")))
    rows = met.groupBy("doc_id", "lang", "code").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r.lang, str(r.doc_id), r.code))
    if not rows:
        return None
    names = sorted({r.lang for r in rows})
    w = words_of([r.text for r in rows])
    labels = np.repeat([names.index(r.lang) for r in rows], w.counts).astype(np.int64)
    if not len(labels):
        return None
    model = WordField(names)
    order, lengths = _strung(w, labels)
    model.train(_picked(w, order), labels[order], lengths)
    return model


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of ``docs``."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2 << 20):
            texts = b.column(1).to_pylist()
            names, scores = model.value.predict(texts) if model.value else (["und"] * len(texts), np.zeros(len(texts)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    said = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {id_type}, lang_pred string, score double")
    return said.select("doc_id", (crc32_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
