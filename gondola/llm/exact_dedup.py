"""Exact deduplication by counting quotient filters.

1. Each partition turns the 64-bit fingerprints of its texts into counting quotient filters: the high bits
   (the quotient) name a run, the low bits (the remainder) are kept sorted within it, each with a count.
2. The filters are cut into ranges of quotients; those of one range, from all partitions, merge by their sorted
   remainders, adding counts. Nothing is lost, since a remainder with its quotient is the whole fingerprint.
   A text that a third of all rows share is one entry of each partition's filter, so no range is hot.
3. Rows whose fingerprint counts once are unique. The others go to byte verification: grouped by the text itself
   (partial sums before the shuffle), so that two texts with one fingerprint stay apart.

Defined cases: a null text counts as empty; empty texts are equal to each other. The row with the largest
doc_id stays; a null doc_id ranks below all others. Repeated rows (same doc_id and text) count in group_size, and
one of them stays. An empty table gives an empty result. Input columns named like output columns are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gondola.llm.common import BROADCAST_ROWS, Workspace, power_of_two, text_or_empty

ADDED = ("keep_id", "group_size", "kept", "text_sha256")
#: Bits of the quotient; the remainder has the other 64 - QUOTIENT_BITS.
QUOTIENT_BITS = 20
#: Fingerprints that one filter takes before it is handed on.
FILTER_ROWS = 1 << 20
#: Fingerprints of all partitions that a range of quotients should hold.
RANGE_ROWS = 1 << 18
SALTS = 16


@dataclass
class CountingQuotientFilter:
    """Sorted runs of remainders, one run for each occupied quotient, with counts.

    `occupied` has a bit for each quotient from `first` on that has a run, `run_ends` a bit for each slot that
    ends a run: together they give each remainder its quotient back.
    """

    first: int
    quotients: int
    bits: int
    occupied: np.ndarray
    run_ends: np.ndarray
    remainders: np.ndarray
    counts: np.ndarray

    @classmethod
    def of(cls, fingerprints: np.ndarray, counts: np.ndarray, bits: int, first: int = 0, quotients: int | None = None):
        """From distinct, ascending unsigned fingerprints."""
        quotients = (1 << bits) if quotients is None else quotients
        quotient = (fingerprints >> np.uint64(64 - bits)).astype(np.int64) - first
        occupied = np.zeros(quotients, bool)
        occupied[quotient] = True
        run_ends = np.ones(len(fingerprints), bool)
        run_ends[:-1] = quotient[1:] != quotient[:-1]
        remainders = fingerprints & np.uint64((1 << (64 - bits)) - 1)
        return cls(first, quotients, bits, np.packbits(occupied), np.packbits(run_ends), remainders, counts)

    def fingerprints(self) -> np.ndarray:
        runs = np.flatnonzero(np.unpackbits(self.occupied, count=self.quotients)) + self.first
        ends = np.unpackbits(self.run_ends, count=len(self.remainders)).astype(np.int64)
        run_of_slot = np.cumsum(ends) - ends
        return (runs[run_of_slot].astype(np.uint64) << np.uint64(64 - self.bits)) | self.remainders

    def range(self, first: int, quotients: int, fingerprints: np.ndarray) -> CountingQuotientFilter:
        shift = np.uint64(64 - self.bits)
        a, b = np.searchsorted(fingerprints >> shift, [first, first + quotients]).tolist()
        return CountingQuotientFilter.of(fingerprints[a:b], self.counts[a:b], self.bits, first, quotients)


def merged(filters: list[CountingQuotientFilter]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct fingerprints, ascending, with their summed counts: two sorted runs at a time."""
    runs = [(f.fingerprints(), f.counts) for f in filters] or [(np.zeros(0, np.uint64), np.zeros(0, np.int64))]
    while len(runs) > 1:
        runs = [_merged_two(*runs[k : k + 2]) if k + 1 < len(runs) else runs[k] for k in range(0, len(runs), 2)]
    return runs[0]


def _merged_two(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    (values, counts), (others, more) = (a, b) if len(a[0]) >= len(b[0]) else (b, a)
    at = np.searchsorted(values, others)
    known = np.zeros(len(others), bool)
    inside = at < len(values)
    known[inside] = values[at[inside]] == others[inside]
    counts = counts.copy()
    counts[at[known]] += more[known]
    return np.insert(values, at[~known], others[~known]), np.insert(counts, at[~known], more[~known])


FILTER_SCHEMA = pa.schema([("range", pa.int32()), ("occupied", pa.binary()), ("run_ends", pa.binary()), ("remainders", pa.binary()), ("counts", pa.binary())])


def _filters(ranges: int, bits: int):
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            whole = CountingQuotientFilter.of(values, counts.astype(np.int64), bits)
            width, out = (1 << bits) // ranges, []
            for k in np.unique((values >> np.uint64(64 - bits)).astype(np.int64) // width).tolist():
                part = whole.range(k * width, width, values)
                out.append((k, part.occupied.tobytes(), part.run_ends.tobytes(), part.remainders.tobytes(), part.counts.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*out), FILTER_SCHEMA)], schema=FILTER_SCHEMA)

        for batch in batches:
            values = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            held.append(values)
            size += len(values)
            if size >= FILTER_ROWS:
                yield from flush()
                held, size = [], 0
        if size:
            yield from flush()

    return build


def _merge(ranges: int, bits: int):
    width = (1 << bits) // ranges

    def merge(rows: pa.Table) -> pa.Table:
        filters = [
            CountingQuotientFilter(row["range"] * width, width, bits, np.frombuffer(row["occupied"], np.uint8), np.frombuffer(row["run_ends"], np.uint8), np.frombuffer(row["remainders"], np.uint64), np.frombuffer(row["counts"], np.int64))
            for row in rows.to_pylist()
        ]
        values, counts = merged(filters)
        more = counts > 1
        return pa.table({"fp": pa.array(values[more].view(np.int64)), "rows": pa.array(counts[more])})

    return merge


def repeated_fingerprints(docs: DataFrame, rows: int) -> DataFrame:
    """(fp, rows) of the fingerprints that more than one row has. rows: about how many rows docs has."""
    ranges = min(1 << QUOTIENT_BITS, power_of_two(max(256, rows / RANGE_ROWS)))
    bits = max(QUOTIENT_BITS, ranges.bit_length() - 1)
    filters = docs.select(F.xxhash64(text_or_empty()).alias("fp")).mapInArrow(_filters(ranges, bits), "range int, occupied binary, run_ends binary, remainders binary, counts binary")
    return filters.groupBy("range").applyInArrow(_merge(ranges, bits), "fp long, rows long")


def _groups(spark: SparkSession, docs: DataFrame, space: Workspace) -> tuple[DataFrame, int]:
    """Verified groups of two rows or more: fp, text_sha256, keep_id, group_size; and how many fingerprints repeat."""
    repeated = space.write(repeated_fingerprints(docs, docs.count()), "repeated")
    n = repeated.count()
    rows = docs.select("doc_id", text_or_empty().alias("text"), F.xxhash64(text_or_empty()).alias("fp"))
    if n <= BROADCAST_ROWS:
        suspects = rows.join(F.broadcast(repeated.select("fp")), "fp", "left_semi")
    else:  # each row has one of SALTS places, each fingerprint all of them
        there = repeated.select("fp", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        suspects = rows.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(there, ["fp", "salt"], "left_semi").drop("salt")
    groups = suspects.groupBy("fp", "text").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.filter("group_size > 1").select("fp", F.sha2("text", 256).alias("text_sha256"), "keep_id", "group_size")
    return space.write(groups, "groups"), n


def _joined(spark: SparkSession, docs: DataFrame, name: str) -> DataFrame:
    """docs with __fp, __sha and, where a text repeats, __keep and __size."""
    groups, n = _groups(spark, docs, Workspace(spark, name))
    groups = groups.toDF("__fp", "__sha", "__keep", "__size")
    rows = docs.withColumns({"__fp": F.xxhash64(text_or_empty()), "__sha": F.sha2(text_or_empty(), 256)})
    side = F.broadcast(groups) if n <= BROADCAST_ROWS // 4 else groups  # else a sort-merge join, whose hot partitions Spark splits
    return rows.join(side, ["__fp", "__sha"], "left")


def annotate(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs (doc_id, text and whatever else) with keep_id, group_size, kept and text_sha256.

    Rows with the same doc_id and text are told apart by a window over just these, so a hot text isn't one window.
    """
    same = Window.partitionBy("__sha", "doc_id").orderBy(F.lit(1))
    alone = F.col("__size").isNull()
    return (
        _joined(spark, docs.drop(*(c for c in docs.columns if c.lower() in ADDED)), "exact")
        .withColumn("__copy", F.row_number().over(same))
        .withColumns({"keep_id": F.when(alone, F.col("doc_id")).otherwise(F.col("__keep")), "group_size": F.coalesce("__size", F.lit(1)), "kept": alone | (F.col("doc_id").eqNullSafe(F.col("__keep")) & (F.col("__copy") == 1)), "text_sha256": F.col("__sha")})
        .drop("__copy", "__fp", "__sha", "__keep", "__size")
    )


def dedup(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows that stay, with the columns of docs."""
    rows = _joined(spark, docs, "exact-keep")
    alone = rows.filter(F.col("__size").isNull())
    firsts = rows.filter(F.col("__size").isNotNull() & F.col("doc_id").eqNullSafe(F.col("__keep"))).dropDuplicates(["__sha"])
    return alone.unionByName(firsts).select(*docs.columns)
