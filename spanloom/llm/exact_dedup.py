"""Exact dedup with counting quotient filters.

Each partition folds the 64-bit fingerprints of its texts into a counting quotient filter: the high
bits (quotient) name a slot and a run, the low bits (remainder) are kept sorted inside the run with a counter.
A filter is shipped as blocks of neighbouring quotients, so filters of any size merge block by block by
merging sorted remainders and adding counts. No bit of a fingerprint is dropped, so the merge is
lossless. Only fingerprints whose merged count exceeds one send their texts to byte verification.

Defined cases: a null text is the empty text; texts that differ only in A-Z against a-z are equal; a
null id is smaller than any id; of rows that repeat the largest id of their group, one stays. An
empty table gives an empty result. Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import listed, own_name, scratch, slices, stage

#: Entries of a merged block of the filter, about; blocks are the unit of merging, and there are more of them for more texts.
BLOCK_ENTRIES = 1 << 18
#: A partition's filter is shipped and begun anew at this many distinct fingerprints.
FILTER_ENTRIES = 1 << 20
#: Share of a filter's slots that are in use, at most.
LOAD = 0.9


class CountingQuotientFilter:
    """Exact multiset of 64-bit fingerprints in 2**bits slots (and some past the end for what is shifted over it).

    The high ``bits`` of a fingerprint are its quotient, the slot where its run would begin; the rest is its remainder. The remainders of one
    quotient stand in one run, sorted, each with its counter; a run that finds its slots taken is shifted on. ``occupied`` marks
    quotients that have a run, ``ends`` the last slot of each run, so the k-th end closes the run of the k-th occupied quotient.
    """

    def __init__(self, bits: int, remainders: np.ndarray, counters: np.ndarray, occupied: np.ndarray, ends: np.ndarray):
        self.bits, self.remainders, self.counters, self.occupied, self.ends = bits, remainders, counters, occupied, ends

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        """``fingerprints`` in any order; equal ones add up."""
        values, where = np.unique(fingerprints.astype(np.uint64), return_inverse=True)
        total = np.zeros(len(values), np.int64)
        np.add.at(total, where, 1 if counts is None else counts)
        return cls._laid(values, total)

    @classmethod
    def _laid(cls, values: np.ndarray, total: np.ndarray) -> CountingQuotientFilter:
        """Sorted distinct fingerprints into slots: each at its quotient or, if that is taken, right after the one before."""
        n = len(values)
        bits = max(1, int(np.ceil(np.log2(max(n, 1) / LOAD))))
        quotient = (values >> np.uint64(64 - bits)).astype(np.int64)
        slot = np.arange(n) + np.maximum.accumulate(quotient - np.arange(n)) if n else quotient
        size = max(1 << bits, int(slot[-1]) + 1 if n else 0)
        remainders, counters = np.zeros(size, np.uint64), np.zeros(size, np.int64)
        occupied, ends = np.zeros(1 << bits, bool), np.zeros(size, bool)
        remainders[slot], counters[slot] = values & np.uint64((1 << (64 - bits)) - 1), total
        occupied[quotient] = True
        ends[slot[np.append(quotient[1:] != quotient[:-1], True)[:n]]] = True
        return cls(bits, remainders, counters, occupied, ends)

    def __len__(self) -> int:
        return int((self.counters > 0).sum())

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """The fingerprints in order, read back from quotients and remainders, and their counts."""
        used = np.flatnonzero(self.counters)
        run = np.cumsum(self.ends[used]) - self.ends[used]
        quotient = np.flatnonzero(self.occupied)[run].astype(np.uint64)
        return (quotient << np.uint64(64 - self.bits)) | self.remainders[used], self.counters[used]

    def count(self, fingerprint: int) -> int:
        """Times that ``fingerprint`` is in: its quotient's run is the one that the same number of ends stands before."""
        quotient, remainder = fingerprint >> (64 - self.bits), fingerprint & ((1 << (64 - self.bits)) - 1)
        if not self.occupied[quotient]:
            return 0
        run = int(self.occupied[:quotient].sum())
        ends = np.flatnonzero(self.ends)
        last = int(ends[run])
        first = max(quotient, int(ends[run - 1]) + 1 if run else 0)
        at = first + int(np.searchsorted(self.remainders[first : last + 1], np.uint64(remainder)))
        return int(self.counters[at]) if at <= last and int(self.remainders[at]) == remainder else 0

    def merge(self, other: CountingQuotientFilter) -> CountingQuotientFilter:
        (a, n), (b, m) = self.items(), other.items()
        return self.of(np.concatenate([a, b]), np.concatenate([n, m]))

    def blocks(self, bits: int) -> Iterator[tuple[int, bytes, bytes]]:
        """(block, its sorted remainders, their counts): the filter by the first ``bits`` of the quotient, whatever the filter's own size."""
        values, counts = self.items()
        block = (values >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(values), np.int64)
        cuts = np.flatnonzero(np.diff(block)) + 1
        rest = values & np.uint64((1 << (64 - bits)) - 1)
        for a, b in zip([0, *cuts], [*cuts, len(block)], strict=True):
            if b > a:
                yield int(block[a]), rest[a:b].tobytes(), counts[a:b].tobytes()

    @classmethod
    def from_blocks(cls, rows: list[tuple[int, bytes, bytes]], bits: int) -> CountingQuotientFilter:
        prints = [np.frombuffer(r, np.uint64) | np.uint64(q << (64 - bits) if bits else 0) for q, r, _ in rows]
        counts = [np.frombuffer(c, np.int64) for _, _, c in rows]
        return cls.of(np.concatenate(prints), np.concatenate(counts))


def block_bits(n: int) -> int:
    """Bits that name a block so that n fingerprints make blocks of about BLOCK_ENTRIES."""
    return max(4, (n // BLOCK_ENTRIES).bit_length())


def normal(text: str | None) -> bytes:
    """UTF-8 of the text with A-Z lower-cased and nothing else changed."""
    return (text or "").encode("utf-8", "surrogatepass").lower()


def _keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        texts = [normal(x) for x in b.column(1).to_pylist()]
        prints = np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(prints), pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary())], ["doc_id", "row_id", "fp", "sha"])


def _filters(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One filter per partition (or per FILTER_ENTRIES fingerprints of it), as blocks."""

        def ship(cqf: CountingQuotientFilter) -> pa.RecordBatch:
            q, r, c = zip(*cqf.blocks(bits), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(r, pa.binary()), pa.array(c, pa.binary())], ["quotient", "remainders", "counts"])

        held = None
        for b in batches:
            if b.num_rows:
                new = CountingQuotientFilter.of(b.column(0).to_numpy().view(np.uint64))
                held = new if held is None else held.merge(new)
                if len(held) >= FILTER_ENTRIES:
                    yield ship(held)
                    held = None
        if held is not None:
            yield ship(held)

    return run


def _merged(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows of one block arrive together; emits the fingerprints that count above one."""

        def repeated(rows: list[tuple[int, bytes, bytes]]) -> pa.RecordBatch:
            values, counts = CountingQuotientFilter.from_blocks(rows, bits).items()
            return pa.RecordBatch.from_arrays([pa.array(values[counts > 1].view(np.int64)), pa.array(counts[counts > 1])], ["fp", "n"])

        block, rows = None, []
        for b in batches:
            for q, r, c in zip(*(x.to_pylist() for x in b.columns), strict=True):
                if q != block and rows:
                    yield repeated(rows)
                    rows = []
                block = q
                rows.append((q, r, c))
        if rows:
            yield repeated(rows)

    return run


def repeated_fingerprints(keys: DataFrame) -> DataFrame:
    """``fp``, ``n`` of the fingerprints that the merged filters count more than once; ``keys`` (fp) is counted first: pass a staged table."""
    bits = block_bits(keys.count())
    parts = keys.select("fp").mapInArrow(_filters(bits), "quotient int, remainders binary, counts binary")
    return parts.repartition("quotient").sortWithinPartitions("quotient").mapInArrow(_merged(bits), "fp long, n long")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "text"):
        texts = [normal(x) for x in b.column(0).to_pylist()]
        prints = np.array([xxhash.xxh64_intdigest(t) for t in texts], np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(prints), pa.array(texts, pa.binary())], ["fp", "bytes"])


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (of the normal text)."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    with_id = source.withColumn("row_id", F.monotonically_increasing_id())
    id_type = source.schema["doc_id"].dataType.simpleString()
    keys = stage(with_id.mapInArrow(_keys, f"doc_id {id_type}, row_id long, fp long, sha binary"), "dedup-keys")
    repeats = stage(repeated_fingerprints(keys), "dedup-repeats")
    # byte verification: rows of repeated fingerprints are grouped by their very bytes
    few = listed(repeats.select("fp"))  # broadcast where it is short, or all texts would be shuffled
    texts = source.select("text").mapInArrow(_texts, "fp long, bytes binary").join(few, "fp", "left_semi")
    proved = texts.groupBy("fp", "bytes").agg(F.count(F.lit(1)).alias("size")).select("fp", F.unhex(F.sha2("bytes", 256)).alias("sha"), "size")
    # rows of one fingerprint and digest must be one run of equal bytes
    proved = proved.groupBy("fp", "sha").agg(F.sum("size").alias("group_size"), F.count(F.lit(1)).alias("runs")).where(
        F.when(F.col("runs") == 1, True).otherwise(F.raise_error(F.lit("two texts share a SHA-256 digest")).cast("boolean"))
    )
    best = F.max(F.struct("doc_id", "row_id")).alias("best")
    shared = keys.join(few, "fp", "left_semi").groupBy("fp", "sha").agg(best).join(proved, ["fp", "sha"])
    shared = shared.select("fp", "sha", F.col("best.doc_id").alias("keep_id"), F.col("best.row_id").alias("keep_row"), "group_size")
    # written first: Spark can then split a hot fingerprint's rows in the join, or broadcast a small table
    out = keys.join(stage(shared, "dedup-groups"), ["fp", "sha"], "left")
    single = F.col("group_size").isNull()
    return out.select(
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (single | (F.col("row_id") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_exact(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts the one with the largest id, then hash of the text as it is."""
    row, place = own_name("_row", docs), own_name("_place", docs)
    held = stage(docs.withColumn(row, F.monotonically_increasing_id()), "dedup-docs")
    placed = held.withColumn(place, F.struct(F.col(id_col).alias("id"), F.xxhash64("text").alias("code"), F.col(row).alias("row")))
    with scratch(docs.sparkSession):
        kept = stage(exact_groups(placed, place).where("kept").select(F.col("doc_id.row").alias(row)), "dedup-kept", lasting=True)
    return held.join(listed(kept), row, "left_semi").select(*docs.columns)
