"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Every text becomes a fixed row of statistics of its characters, words and lines, whatever its language. Random
Fourier features of the standardised row approximate a Gaussian kernel; they and a constant are all that the regression
sees. Each partition of the labelled rows sums its normal equations (a matrix of fixed size), sums are summed FAN at a
time until few are left, and the driver solves one ridge system. A fifth of the labelled rows is held back: their scores,
counted in SCORE_BINS bins, calibrate by pooling adjacent violators. A thousandth of the raw score stays in the result so
that equal steps keep their order.

Only the text enters a score; doc_id merely names rows and picks the calibration fold.

Defined cases: null counts as empty, and empty texts have a row of zeros and get a score; labels that are null or
whose document is missing are ignored; without labels every score is 0.5; repeated rows repeat; extra columns don't
matter, whatever their names; very long texts are read whole; equal texts get equal scores; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.llm.common import Workspace, released

FEATURES, SEED = 256, 5
#: Kernel width in units of the root of the number of statistics, and ridge strength for each row.
WIDTH, RIDGE = 1.0, 1e-4
SCORE_BINS, FAN = 1000, 32
STATISTICS = 18


def statistics(text: str | None) -> list[float]:
    """Log length; shares of kinds of characters; word lengths; repetition of words, pairs and lines."""
    if not text:
        return [0.0] * STATISTICS
    n, words = len(text), text.split()
    count, lines = len(words), [x for x in text.split("\n") if x]
    if not count:
        return [math.log1p(n), *[0.0] * (STATISTICS - 1)]
    chars = Counter(text)
    letters = sum(k for c, k in chars.items() if c.isalpha())
    upper = sum(k for c, k in chars.items() if c.isupper())
    digits = sum(k for c, k in chars.items() if c.isdigit())
    space = sum(k for c, k in chars.items() if c.isspace())
    plain = sum(chars.get(c, 0) for c in ".,;:'\"?")
    symbols = n - letters - digits - space - plain
    entropy = -sum(k / n * math.log(k / n) for k in chars.values())
    kinds = Counter(words)
    pairs = len(set(zip(words, words[1:])))
    sizes = [len(w) for w in words]
    mean = sum(sizes) / count
    bare = sum(k for w, k in kinds.items() if not any(map(str.isalpha, w)))
    ends = sum(k for w, k in kinds.items() if w[-1] in ".?!")
    short = sum(k for w, k in kinds.items() if len(w) <= 3 and w.isalpha())
    return [
        math.log1p(n), letters / n, upper / max(1, letters), digits / n, symbols / n, plain / n, entropy,
        mean, math.sqrt(max(0.0, sum(s * s for s in sizes) / count - mean * mean)),
        len(kinds) / count**0.9, math.log(kinds.most_common(1)[0][1] / count), pairs / max(1, count - 1), sum(a == b for a, b in zip(words, words[1:])) / count,
        bare / count, ends / count, short / count, len(set(lines)) / max(1, len(lines)), math.log1p(count / max(1, len(lines))),
    ]


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    knots: np.ndarray  # raw scores, ascending, and their calibrated values
    values: np.ndarray

    def raw(self, rows: np.ndarray) -> np.ndarray:
        return expanded((rows - self.mean) / self.scale) @ self.weights

    def score(self, rows: np.ndarray) -> np.ndarray:
        raw = self.raw(rows)
        return 0.999 * np.interp(raw, self.knots, self.values) + 0.001 * np.clip(raw, 0, 1)


def expanded(rows: np.ndarray) -> np.ndarray:
    """Random Fourier features and a constant."""
    rows = np.clip(rows, -8, 8)
    rng = np.random.default_rng(SEED)
    directions = rng.standard_normal((rows.shape[1], FEATURES)) / (WIDTH * math.sqrt(rows.shape[1]))
    phases = rng.uniform(0, 2 * math.pi, FEATURES)
    return np.concatenate([math.sqrt(2 / FEATURES) * np.cos(rows @ directions + phases), np.ones((len(rows), 1))], axis=1)


def pooled(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: ends of each block and its mean."""
    blocks: list[list[float]] = []
    for a, v, w in zip(x.tolist(), y.tolist(), weight.tolist()):
        blocks.append([a, a, v, w])
        while len(blocks) > 1 and blocks[-2][2] >= blocks[-1][2]:
            _, b, v2, w2 = blocks.pop()
            blocks[-1][1:] = b, (blocks[-1][2] * blocks[-1][3] + v2 * w2) / (blocks[-1][3] + w2), blocks[-1][3] + w2
    return np.array([e for k in blocks for e in k[:2]]), np.array([e for k in blocks for e in (k[2], k[2])])


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            part = batch.slice(a, 512)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([statistics(t.as_py()) for t in part.column(1)], pa.list_(pa.float64()))], names=["doc_id", "row"])


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, row): the statistics of every text."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(released(_statistics), "doc_id long, row array<double>")


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.array(column.to_pylist(), float).reshape(-1, STATISTICS)


def _summed(space: Workspace, name: str, rows: DataFrame, product) -> np.ndarray:
    """Sum over all rows of product(statistics, label), a vector of fixed size: by partition, then FAN sums at a time."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for a in range(0, batch.num_rows, 4096):
                part = batch.slice(a, 4096)
                found = product(_matrix(part.column(0)), np.array(part.column(1).to_pylist(), float))
                total = found if total is None else total + found
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([total.tobytes()])], names=["part", "data"])

    def both(table: pa.Table) -> pa.Table:
        order = np.argsort(table["part"].to_numpy(), kind="stable")  # sums come out the same each time
        data = [table["data"][k].as_py() for k in order.tolist()]
        return pa.table({"part": pa.array([int(table["part"].to_numpy().min())], pa.int32()), "data": pa.array([sum(map(np.frombuffer, data)).tobytes()], pa.binary())})

    sums, turn = space.write(rows.select("row", "label").mapInArrow(local, "part int, data binary"), f"{name}-0"), 0
    while (n := sums.count()) > FAN:
        turn += 1
        groups = sums.groupBy(F.pmod(F.xxhash64("part"), F.lit(-(-n // FAN))).alias("group"))
        sums = space.write(groups.applyInArrow(both, "part int, data binary"), f"{name}-{turn}")
    parts = sorted(sums.collect(), key=lambda p: p["part"])  # FAN at most
    return np.sum([np.frombuffer(p["data"]) for p in parts], axis=0) if parts else np.zeros(0)


def _moments(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.concatenate([[len(x)], x.sum(axis=0), (x * x).sum(axis=0)])


def train(spark: SparkSession, rows: DataFrame) -> Model | None:
    """rows: doc_id, row, label (0 or 1). None without labelled rows."""
    space = Workspace(spark, "quality-sums")
    rows = rows.withColumn("held", F.pmod(F.xxhash64("doc_id", F.lit("held")), F.lit(5)) == 0)
    moments = _summed(space, "moments", rows, _moments)
    if not len(moments):
        return None
    mean = moments[1 : 1 + STATISTICS] / moments[0]
    scale = np.sqrt(np.maximum(moments[1 + STATISTICS :] / moments[0] - mean**2, 1e-6))

    def normal(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        z = np.concatenate([expanded((x - mean) / scale), y[:, None]], axis=1)
        return (z.T @ z).ravel()

    sums = _summed(space, "normal", rows.filter("NOT held"), normal)
    if not len(sums):
        sums = _summed(space, "all", rows, normal)
    size = math.isqrt(len(sums))
    sums = sums.reshape(size, size)
    ridge = RIDGE * max(1.0, sums[-2, -2]) * np.eye(size - 1)
    model = Model(mean, scale, np.linalg.solve(sums[:-1, :-1] + ridge, sums[:-1, -1]), np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    shared = spark.sparkContext.broadcast(model)

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(shared.value.raw(_matrix(batch.column(0)))), batch.column(1)], names=["raw", "label"])

    bins = rows.filter("held").select("row", "label").mapInArrow(raw, "raw double, label double")
    bins = bins.groupBy(F.floor(F.least(F.greatest("raw", F.lit(-0.5)), F.lit(1.5)) * (SCORE_BINS // 2)).alias("bin")).agg(F.avg("raw").alias("x"), F.avg("label").alias("y"), F.count(F.lit(1)).alias("n")).orderBy("x").collect()
    if bins:
        n = np.array([b["n"] for b in bins], float)
        model.knots, model.values = pooled(np.array([b["x"] for b in bins]), np.array([b["y"] for b in bins]), n)
    return model


def scored(spark: SparkSession, rows: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, score, predicted) of measured rows."""
    if model is None:
        return rows.select("doc_id", F.lit(0.5).alias("score"), F.lit(1).alias("predicted"))
    shared = spark.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return rows.select("doc_id", "row").mapInArrow(apply, "doc_id long, score double, predicted int")


def classify(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: doc_id, score, predicted. labels: doc_id, quality; the only labels learned from."""
    rows = Workspace(spark, "quality").write(measured(docs), "measured")
    known = labels.select(F.col("doc_id").cast("long"), F.col("quality").cast("double").alias("label")).filter("label IN (0, 1)")
    return scored(spark, rows, train(spark, rows.join(known, "doc_id")))
