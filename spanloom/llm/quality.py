"""Quality of documents by a linear-chain conditional random field over lines.

Each line has features of its own (character classes, words, repeats within the document, place) and those of
the lines before and after it. The field labels every line good or bad; forward-backward gives each
line's marginal, and the marginals weighted by the lines' lengths are the document's quality. A last
logistic step, fitted on the same sample, maps that mean to the label's probability.

Labels mark documents, so the lines' labels are latent. They begin as the document's label; after each of PASSES trainings
the lines that the field is SURE of on the other side take that side, as long as most of the document's length
keeps its label, and the field is trained again. To learn the moves between both kinds of lines, documents of
either label are also joined to one, good first and bad first in turn, whose lines keep their documents' labels.

Training reads labelled documents outside the held-out fold only: for each label the SAMPLE rows of labelled documents of at
most SAMPLE_BYTES bytes whose id has the smallest hash. Prediction reads whole texts only.

Defined cases: null and empty texts are one empty line; without labelled rows every score is 0.5; with one
label only, the score is the smoothed share of that label; a null id predicts like any other;
repeated rows score alike; an empty table gives an empty result; extra columns are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .chars import BANG, BAR, CLASSES, SPACE, STOP, UPPER, classes, code_points
from .common import crc32_mod, own_name, slices, stage
from .crf import Adam, Chains, forward_backward, gold_counts

FOLDS, HELD_OUT = 3, 1
SAMPLE = 1500
SAMPLE_BYTES = 1 << 16
ROUNDS = 120
#: Trainings with lines labelled anew, rounds of each, and the marginal from which a line takes the other label.
PASSES, AGAIN, SURE = 2, 60, 0.9
#: Bytes of texts whose lines are held at once, about: their features take some 30 times as much.
TEXT_BYTES = 1 << 20


def line_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line of every text, lines of each text, weight (length + 1) of each line."""
    docs = [(t or "").split("\n") for t in texts]
    counts = np.array([len(d) for d in docs], np.int64)
    points = code_points("\n".join(t or "" for t in texts) + "\n")
    kind = classes(points)
    ends = np.flatnonzero(points == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    length = ends - starts
    n = len(ends)
    line = np.repeat(np.arange(n), length + 1)
    by = np.bincount(line * CLASSES + kind, minlength=n * CLASSES).reshape(n, CLASSES).astype(np.float32)
    by[:, SPACE] -= 1  # the newline itself
    space = kind == SPACE
    begins = ~space
    begins[1:] &= space[:-1]
    at = np.flatnonzero(begins)
    words = np.bincount(line[at], minlength=n).astype(np.float32)
    same = np.zeros(n, np.float32)
    if len(at) > 1:  # words that repeat the word before them in their line
        code = word_codes(points, space, at)
        same = np.bincount(line[at[1:]], weights=(code[1:] == code[:-1]) & (line[at[1:]] == line[at[:-1]]), minlength=n).astype(np.float32)
    size = np.maximum(length, 1).astype(np.float32)
    last = np.where(length > 0, kind[np.maximum(ends - 1, 0)], SPACE)
    first = np.where(length > 0, kind[starts], SPACE)
    repeats = np.concatenate([np.array([c[x] for x in d], np.float32) for d in docs for c in (Counter(d),)]) if docs else np.zeros(0, np.float32)
    top = np.cumsum(counts) - counts
    edge = np.zeros(n, np.float32)
    edge[top] = 1
    own = np.column_stack(
        [by / size[:, None], np.log1p(length), np.log1p(words), np.minimum((length - by[:, SPACE]) / np.maximum(words, 1), 40) / 10, last == STOP, last == BANG, first == UPPER,
         by[:, BANG] / np.maximum(words, 1), by[:, BAR] / np.maximum(words, 1), same / np.maximum(words, 1), np.log(np.maximum(repeats, 1)), edge]
    ).astype(np.float32)
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    before[top], after[top + counts - 1] = 0, 0
    return np.hstack([own, before, after]), counts, (length + 1).astype(np.float64)


def word_codes(points: np.ndarray, space: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 32-bit code of each word that begins at ``at``, from its code points and their places."""
    starts = np.repeat(at, np.diff([*at, len(points)]))
    place = np.arange(at[0], len(points)) - starts
    mixed = (points[at[0] :] + np.uint32(1)) * np.uint32(2654435761) ^ (place.astype(np.uint32) * np.uint32(40503))
    mixed *= np.uint32(2246822519)
    mixed[space[at[0] :]] = 0
    return np.add.reduceat(mixed, at - at[0])


def means(post: np.ndarray, counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Length-weighted mean of the lines' marginals of good."""
    starts = np.cumsum(counts) - counts
    return np.add.reduceat(post[:, 1] * weight, starts) / np.add.reduceat(weight, starts)


def relabelled(post: np.ndarray, counts: np.ndarray, weight: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Labels of the lines: the document's, but for lines that the field is SURE of on the other side, surest first, up to under half the length."""
    doc = np.repeat(np.arange(len(counts)), counts)
    own = labels[doc]
    other = post[np.arange(len(own)), 1 - own]
    order = np.lexsort((-other, doc))
    size = weight[order]
    ends = np.cumsum(size)
    starts = np.cumsum(counts) - counts
    taken = ends - np.repeat(np.concatenate([[0.0], ends])[starts], counts)
    total = np.add.reduceat(weight, starts)[doc]
    out = own.copy()
    flip = order[(other[order] >= SURE) & (2 * taken < total)]
    out[flip] = 1 - own[flip]
    return out


def _logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


class LineField:
    """The trained field: standardisation, weights, moves, first labels and the final logistic step."""

    def __init__(self, features: np.ndarray, counts: np.ndarray, weight: np.ndarray, labels: np.ndarray, joined: np.ndarray | None = None):
        """``labels``: of the first documents; those after them are joined ones, whose lines' labels ``joined`` holds."""
        self.mean, self.dev = features.mean(axis=0), features.std(axis=0) + 1e-3
        x = self._scaled(features)
        self.w, self.move, self.begin = np.zeros((x.shape[1], 2)), np.zeros((2, 2)), np.zeros(2)
        single = counts[: len(labels)]
        chains, own = Chains.of(counts), int(single.sum())
        lines, known = np.repeat(labels, single), np.zeros(0, np.int64) if joined is None else joined
        adam, n = Adam(0.05), len(x)
        for turn in range(1 + PASSES):
            if turn:
                lines = relabelled(forward_backward(x @ self.w, chains, self.move, self.begin)[0][:own], single, weight[:own], labels)
            hot, moves, firsts = gold_counts(np.concatenate([lines, known]), counts, 2)
            for _ in range(AGAIN if turn else ROUNDS):
                post, seen, begun, _ = forward_backward(x @ self.w, chains, self.move, self.begin, pairs=True)
                adam.begin()
                adam.step("w", self.w, x.T @ (hot - post) / n - 1e-4 * self.w)
                adam.step("move", self.move, (moves - seen) / n - 1e-3 * self.move)
                adam.step("begin", self.begin, (firsts - begun) / len(counts) - 1e-3 * self.begin)
        z = _logit(means(forward_backward(x[:own] @ self.w, Chains.of(single), self.move, self.begin)[0], single, weight[:own]))
        self.slope, self.shift = 1.0, 0.0
        for _ in range(200):  # Newton would do in fewer; the function is smooth and has two unknowns
            p = 1 / (1 + np.exp(-(self.slope * z + self.shift)))
            self.slope += 0.05 * float(((labels - p) * z).mean())
            self.shift += 0.2 * float((labels - p).mean())
        self.slope = max(self.slope, 0.05)

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        x = np.clip((x - self.mean) / self.dev, -8, 8)
        return np.hstack([x, np.ones((len(x), 1), x.dtype)])

    def line_marginals(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return forward_backward(self._scaled(features) @ self.w, Chains.of(counts), self.move, self.begin)[0]

    def scores(self, texts: list[str | None]) -> np.ndarray:
        features, counts, weight = line_features(texts)
        z = _logit(means(self.line_marginals(features, counts), counts, weight))
        return 1 / (1 + np.exp(-(self.slope * z + self.shift)))


class Constant:
    def __init__(self, score: float):
        self.score = score

    def scores(self, texts: list[str | None]) -> np.ndarray:
        return np.full(len(texts), self.score)


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text", TEXT_BYTES):
        features, counts, weight = line_features(b.column(0).to_pylist())
        cuts = np.cumsum(counts)[:-1]
        f, w = np.split(features, cuts), np.split(weight, cuts)
        yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array([x.tobytes() for x in f], pa.binary()), pa.array([x.tobytes() for x in w], pa.binary())], ["rank", "label", "first", "features", "weight"])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> LineField | Constant:
    """Train on a bounded sample of the labelled rows outside the held-out fold: the documents are joined with their labels first."""
    known = labels.select(F.col("doc_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null").where(crc32_mod(F.col("doc_id"), FOLDS) != HELD_OUT).distinct()
    fits = docs.select("doc_id", F.xxhash64("text").alias("code"), "text").where(F.octet_length("text") <= SAMPLE_BYTES)
    marked = stage(fits.select("doc_id", "code").join(known, "doc_id").distinct(), "quality-marked")
    order = [F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id").cast("string"), "code"]
    least = [marked.where(F.col("label") == v).orderBy(*order).limit(sample) for v in (0, 1)]
    chosen = stage(least[0].unionByName(least[1]), "quality-sample")  # 2 * sample rows at most
    # a chosen row that is repeated is read once
    few = fits.join(F.broadcast(chosen), ["doc_id", "code"]).groupBy("doc_id", "code", "label").agg(F.min("text").alias("text"))
    rank = F.row_number().over(W.partitionBy("label").orderBy(*order))
    few = stage(few.select("text", rank.alias("rank"), "label", F.size(F.split("text", "\n", -1)).alias("first")), "quality-texts")
    good, bad = few.where("label = 1"), few.where("label = 0").select("rank", F.col("text").alias("other"), F.col("first").alias("others"))
    both, turned = good.join(bad, "rank"), F.col("rank") % 2 == 0
    text = F.when(turned, F.concat_ws("\n", "text", "other")).otherwise(F.concat_ws("\n", "other", "text"))
    # label 2: good lines first, 3: bad lines first
    both = both.select(text.alias("text"), "rank", F.when(turned, 2).otherwise(3).alias("label"), F.when(turned, F.col("first")).otherwise(F.col("others")).alias("first"))
    rows = few.unionByName(both).mapInArrow(_sample_features, "rank int, label int, first int, features binary, weight binary").collect()
    rows.sort(key=lambda r: (r.label > 1, r.rank, r.label))
    y = np.array([r.label for r in rows if r.label < 2], np.int64)
    if len(set(y.tolist())) < 2:
        return Constant((y.sum() + 1) / (len(y) + 2) if len(y) else 0.5)
    features = [np.frombuffer(r.features, np.float32) for r in rows]
    counts = np.array([len(r.weight) // 8 for r in rows], np.int64)
    matrix = np.vstack([f.reshape(c, -1) for f, c in zip(features, counts, strict=True)]).astype(np.float64)
    joined = np.concatenate([(np.arange(c) < r.first) == (r.label == 2) for r, c in zip(rows, counts.tolist(), strict=True) if r.label > 1]).astype(np.int64)
    return LineField(matrix, counts, np.concatenate([np.frombuffer(r.weight, np.float64) for r in rows]), y, joined)


def score_texts(docs: DataFrame, model: LineField | Constant, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name`` added."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", TEXT_BYTES):
            scores = held.value.scores(b.column(b.schema.get_field_index("text")).to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*b.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``."""
    scored = score_texts(docs.select("doc_id", "text"), fit(docs, labels)).drop("text")
    return scored.select("doc_id", (crc32_mod(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, with all their columns."""
    name = own_name("score", docs)
    return score_texts(docs, fit(docs, labels), name).where(F.col(name) >= 0.5).select(*docs.columns)
