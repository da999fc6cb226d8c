"""Compression of vectors to product codes: integer k-means for each part, assignment by partial-distance search.

A vector becomes integers floor(SCALE x), cut into PARTS equal parts; each part position has a codebook of at most
ENTRIES entries, which starts as that part of the first vectors by id. A round assigns every part to its nearest entry
(squared Euclidean distance, ties to the lower index) and moves each used entry to the floored mean of its parts.

Assignment is a partial-distance search over the vectors of an Arrow batch at once: dimensions go in descending variance
of the codebook; the entry nearest in the first of them gets its complete distance, which is the bound; then each
dimension adds to the accumulated distances of the (vector, entry) pairs still alive, and a mask drops those that
strictly exceed the bound. Pairs that equal it stay, so ties are seen, and the result is that of a full search.

A round is one pass over the table: each task sends a count and sums for each entry, which Spark adds up; the driver
sees the codebooks only (PARTS x ENTRIES x length of a part). Nothing grows with a label or an id.

Defined cases: rows whose vector is null or holds null or non-finite components are dropped; a null id comes after all
others, and rows of one id are ordered by their vectors. Shorter vectors count as zeros beyond their end, up to the
longest one's length, rounded up to a multiple of PARTS; where all are empty, all codes are 00. Fewer rows than ENTRIES
make shorter codebooks. Null labels are one label. Repeated rows count each. An empty table gives an empty result; extra
columns are ignored, whatever their names. Components and errors beyond 64-bit integers are an error, as in SQL.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.llm.common import Workspace, released

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Below, squared distances of a part fit 64 bits for any length up to 2^13; beyond, Python's integers take over.
_SMALL = 1 << 24
#: Vectors searched at once.
_ROWS = 4096


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, vector (array<long>) of the rows that take part."""
    finite = F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    whole = lambda y: F.when(F.abs(y) < F.lit(2.0**63), F.floor(y).cast("long")).otherwise(F.raise_error(F.lit("a component is out of the range of 64-bit integers")).cast("long"))
    return vectors.filter(finite).select(F.col("vec_id").cast("long"), "label", F.transform("embedding", lambda x: whole(x.cast("double") * scale)).alias("vector"))


def nearest(part: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of the nearest entry of book (entries x dims) for each row of part (rows x dims), and its squared distance."""
    n, entries = len(part), len(book)
    if not part.shape[1]:
        return np.zeros(n, np.int64), np.zeros(n, part.dtype)
    spread = [max(column) - min(column) if book.dtype == object else float(np.var(column)) for column in book.T]
    order = sorted(range(part.shape[1]), key=lambda k: -spread[k])
    first = (part[:, order[0], None] - book[None, :, order[0]]) ** 2
    guess = first.argmin(axis=1)
    bound = ((part - book[guess]) ** 2).sum(axis=1)
    rows, entry = np.nonzero(first <= bound[:, None])
    total = first[rows, entry]
    for k in order[1:]:
        total = total + (part[rows, k] - book[entry, k]) ** 2
        alive = total <= bound[rows]
        rows, entry, total = rows[alive], entry[alive], total[alive]
    best, index = bound.copy(), np.full(n, entries, np.int64)
    _least_at(best, rows, total)
    hit = total == best[rows]
    np.minimum.at(index, rows[hit], entry[hit])
    return index, best


def _least_at(best: np.ndarray, rows: np.ndarray, total: np.ndarray) -> None:
    """best[r] becomes the least total of its rows; rows ascend and none is missing, as the guess of each row survives."""
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.zeros(0, np.int64)
    if len(starts):
        best[:] = np.minimum.reduceat(total, starts)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of width components, zeros beyond a vector's end; Python's integers where 64 bits might overflow."""
    lengths = np.diff(column.offsets.to_numpy())
    values = column.flatten().to_numpy()
    out = np.zeros((len(column), width), np.int64)
    rows = np.repeat(np.arange(len(column)), lengths)
    out[rows, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    small = -_SMALL < values.min(initial=0) and values.max(initial=0) < _SMALL
    return out if small else out.astype(object)


def _searched(column: pa.Array, books: list[np.ndarray], width: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(part, rows of the part, indexes, distances) of each part position."""
    data, step = _matrix(column, width), width // PARTS
    for p, book in enumerate(books):
        part = np.ascontiguousarray(data[:, p * step : (p + 1) * step])
        if part.dtype != object and max(abs(int(book.min(initial=0))), abs(int(book.max(initial=0)))) < _SMALL:
            yield p, part, *nearest(part, book.astype(np.int64))
        else:
            yield p, part, *nearest(part.astype(object), book)


_SUMS = "slot int, total decimal(38,0)"


def _sums(books: list[np.ndarray], width: int):
    """slot: (part, entry, component), or past a part's last component the number of parts of the entry."""
    step = width // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, int] = {}
        for batch in batches:
            for a in range(0, batch.num_rows, _ROWS):
                for p, part, index, _ in _searched(batch.column(0).slice(a, _ROWS), books, width):
                    for entry in np.unique(index).tolist():
                        mine = part[index == entry]
                        base = (p * ENTRIES + entry) * (step + 1)
                        for k, x in enumerate([*mine.sum(axis=0).tolist(), len(mine)]):
                            totals[base + k] = totals.get(base + k, 0) + int(x)
        if totals:
            yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.int32()), pa.array([Decimal(x) for x in totals.values()], pa.decimal128(38, 0))], names=["slot", "total"])

    return run


def _encoded(books: list[np.ndarray], width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, _ROWS):
                part = batch.slice(a, _ROWS)
                codes, error = np.zeros((part.num_rows, PARTS), np.uint8), [0] * part.num_rows
                for p, _, index, best in _searched(part.column(1), books, width):
                    codes[:, p], error = index, [e + int(b) for e, b in zip(error, best.tolist())]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array([c.tobytes().hex() for c in codes]), pa.array(error, pa.int64())], names=["vec_id", "label", "code", "error"])

    return run


def train(spark: SparkSession, rows: DataFrame, rounds: int = ROUNDS) -> tuple[list[np.ndarray], int]:
    """The codebooks (PARTS arrays of entries x components, Python integers) and the padded length. rows: of integers(), in a table."""
    longest = rows.agg(F.max(F.size("vector"))).first()[0] or 0
    width = -(-longest // PARTS) * PARTS
    step = width // PARTS
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").select("vector").limit(ENTRIES).collect()
    start = [list(r.vector) + [0] * (width - len(r.vector)) for r in first]
    books = [np.array([v[p * step : (p + 1) * step] for v in start], dtype=object).reshape(len(start), step) for p in range(PARTS)]
    for _ in range(rounds if first else 0):
        sums = rows.select("vector").mapInArrow(released(_sums(books, width)), _SUMS).groupBy("slot").agg(F.sum("total").alias("total"))
        totals = {r.slot: int(r.total) for r in sums.collect()}  # at most PARTS x ENTRIES x (components and a count)
        books = [book.copy() for book in books]
        for p, book in enumerate(books):
            for entry in range(len(book)):
                base = (p * ENTRIES + entry) * (step + 1)
                if n := totals.get(base + step, 0):
                    book[entry] = [totals[base + k] // n for k in range(step)]
    return books, width


def digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for book in books for entry in book for x in entry).encode()).hexdigest()


def encode(spark: SparkSession, vectors: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, code (two hex digits a part), error (squared distances summed) of the rows that take part; the codebooks."""
    space = Workspace(spark, "codes")
    rows = space.write(integers(vectors), "vectors")
    books, width = train(spark, rows, rounds)
    kind = rows.schema["label"].dataType.simpleString()
    coded = rows.select("vec_id", "vector", "label").mapInArrow(released(_encoded(books, width)), f"vec_id long, label {kind}, code string, error long")
    return space.write(coded, "coded"), books


def label_errors(coded: DataFrame) -> DataFrame:
    """coded with label_error, the errors of one label summed: before the shuffle, then joined back."""
    sums = coded.groupBy(F.col("label").alias("__label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, F.col("label").eqNullSafe(F.col("__label"))).drop("__label")
