"""Exact top-k inner products by norm-bucketed retrieval.

Vectors become integers, sorted into buckets of like length (norm), longest first. The first bucket alone gives each
query a floor: its k-th best score there. In any other bucket only a vector whose cosine with the query reaches
floor / (query norm x longest norm of the bucket), the local threshold, can still matter:

* above 1, the whole bucket is pruned for that query;
* otherwise, LENGTH pruning takes the bucket's vectors long enough for the floor, a prefix, as they are sorted;
* or, where the local threshold is high enough for it to be selective, COORDINATE pruning keeps the vectors whose
  components on the query's largest coordinates lie in the regions that the threshold leaves feasible.

What survives is verified by exact integer products. Norms fall into at most RANGES ranges; a range is cut by hashed id
into buckets of bounded size, so equal norms and repeated vectors are no hot group. Queries travel in blocks of like
floors (floor / query norm), and a block goes only to the ranges whose longest vector can reach the least floor of its
queries: what is pruned by length is never shuffled. Every (block, bucket) pair returns k rows for each query at most.

Defined cases: vectors that are null, empty, hold null or non-finite components, or differ in dimension from the query
take no part; a null id takes no part; equal scores go to the smaller id; a query's own row is no candidate; fewer than k
candidates give all of them; repeated ids are candidates each (but never of their own id); an empty table gives an
empty result; extra columns are ignored, whatever their names. Components and scores are 64-bit integers: a finite
component or a candidate's score beyond them is an error, as in SQL.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gondola.llm.common import BROADCAST_ROWS, Workspace

K, SCALE = 10, 1024
#: Vectors of a bucket, about, at least and (as their number grows, for fewer meetings of blocks and buckets) at most.
BUCKET_ROWS, MOST_ROWS = 2048, 32768
BLOCK_QUERIES, RANGES = 1024, 256
#: Coordinates that coordinate pruning looks at, and the local threshold from which it is tried.
FOCUS, SELECTIVE = 3, 0.6
SLACK = 1 - 1e-9


def integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(vec_id, vector, norm, dim): floor(scale * x) of the rows that take part."""
    whole_number = lambda y: F.when(F.abs(y) < F.lit(2.0**63), F.floor(y).cast("long")).otherwise(F.raise_error(F.lit("a component is out of the range of 64-bit integers")).cast("long"))
    whole = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = vectors.filter(F.col("vec_id").isNotNull() & whole)
    rows = rows.select(F.col("vec_id").cast("long"), F.transform("embedding", lambda x: whole_number(x.cast("double") * scale)).alias("vector"))
    return rows.withColumns({"norm": F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x.cast("double") * x)), "dim": F.size("vector").cast("long")})


def _blocks(rows: DataFrame, key: list[str], floors: bool = False) -> DataFrame:
    """Rows of one key (dim is part of it) as one row: ids, data (vectors row by row) and, if asked, floors and the least reach."""

    def together(table: pa.Table) -> pa.Table:
        table = table.sort_by([("norm", "descending"), ("vec_id", "ascending")])
        vectors = table["vector"].combine_chunks()
        out = {**{k: [table[k][0].as_py()] for k in key}, "ids": pa.array([table["vec_id"].to_numpy().tobytes()], pa.binary()), "data": pa.array([_packed(vectors.flatten().to_numpy())], pa.binary())}
        if floors:
            out |= {"floors": pa.array([table["low"].to_numpy().tobytes()], pa.binary()), "reach": pa.array([min(table["reach"].to_pylist())], pa.float64())}
        return pa.table(out)

    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.groupBy(*key).applyInArrow(together, ", ".join([*(f"{k} {types[k]}" for k in key), "ids binary, data binary", *["floors binary, reach double"] * floors]))


def _packed(flat: np.ndarray) -> bytes:
    """The width in bytes, 4 where all integers fit, and the integers."""
    width = 4 if np.abs(flat).max(initial=0) < 2**31 else 8
    return bytes([width]) + flat.astype(f"<i{width}").tobytes()


def _matrix(ids: bytes, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    who = np.frombuffer(ids, np.int64)
    return who, np.frombuffer(data, f"<i{data[0]}", offset=1).astype(np.int64).reshape(len(who), -1)


def survivors(query: np.ndarray, floor: float, vectors: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """Rows of a bucket (norms descending) that may reach the floor."""
    size = float(np.sqrt(query.astype(float) @ query))
    slack = SLACK
    if floor <= 0 or size == 0:
        return np.arange(len(vectors))
    local = floor * slack / (size * norms[0]) if norms[0] > 0 else np.inf
    if local > 1:
        return np.zeros(0, np.int64)
    if local < SELECTIVE:  # length: the prefix with norm >= floor / |q|
        return np.arange(int(np.searchsorted(-norms, -floor * slack / size, side="right")))
    unit = query / size
    focus = np.argsort(-np.abs(unit))[:FOCUS]
    keep = norms >= floor * slack / size
    for c in focus:  # with cosine >= t, a component lies within t u +- sqrt((1 - t^2)(1 - u^2))
        spread = np.sqrt(max(0.0, (1 - local**2) * (1 - unit[c] ** 2))) + 1e-9
        low = local * unit[c] - spread if unit[c] >= 0 and unit[c] < local else -1.0
        high = local * unit[c] + spread if unit[c] < 0 and -unit[c] < local else 1.0
        part = vectors[:, c] / np.maximum(norms, 1e-300)
        keep &= (part >= low - 1e-9) & (part <= high + 1e-9)
    return np.flatnonzero(keep)


def best(query_ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, id, score) of the k best in this bucket for each query, score >= floor."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    if queries.shape[1] == vectors.shape[1]:
        norms = np.sqrt((vectors.astype(float) ** 2).sum(axis=1))
        exact = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * vectors.shape[1] < 2**53
        as_float = vectors.astype(float) if exact else None
        for q, query, floor in zip(query_ids.tolist(), queries, floors.tolist()):
            rows = survivors(query, floor, vectors, norms)
            if exact:  # products of this size are exact in doubles, and much faster
                part = as_float if len(rows) == len(ids) else as_float[rows]
                score = (part @ query.astype(float)).astype(np.int64)
            else:
                score = vectors[rows] @ query  # wraps, so it is exact if it fits
                size = np.sqrt((query.astype(float) ** 2).sum())
                for row in rows[(norms[rows] * size >= 2.0**62) & (ids[rows] != q)].tolist():
                    if not -(2**63) <= sum(a * b for a, b in zip(vectors[row].tolist(), query.tolist())) < 2**63:
                        raise OverflowError(f"the score of {q} and {ids[row]} is out of the range of 64-bit integers")
            own = (ids[rows] != q) & (score >= floor)
            rows, score = rows[own], score[own]
            if len(rows) > k:
                edge = np.partition(score, len(score) - k)[len(score) - k]
                rows, score = rows[score >= edge], score[score >= edge]
            order = np.lexsort((ids[rows], ~score))[:k]
            out.append((np.full(len(order), q), ids[rows[order]], score[order]))
    if not out:
        none = np.zeros(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*out))


_PAIRS = "query_id long, vec_id long, score long"
LOW = -(2.0**63)


def _search(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                query_ids, queries = _matrix(row["q_ids"], row["q_data"])
                floors = np.frombuffer(row["floors"], float) if row.get("floors") else np.full(len(query_ids), LOW)
                found = best(query_ids, queries, floors, *_matrix(row["ids"], row["data"]), k)
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in found], names=["query_id", "vec_id", "score"])

    return run


def _cuts(rows: DataFrame, column: str, many: int) -> F.Column:
    """Number of the range that a value falls into, 0 for the largest; at most `many` ranges of about equal size."""
    found = rows.select(F.percentile_approx(column, [i / many for i in range(1, many)] or [0.5], 10_000)).first()[0]
    return F.size(F.filter(F.array(*map(F.lit, sorted(set(found or [0.0])))), lambda c: c > F.col(column))).cast("long")


def _hashed(salt: str, parts: F.Column) -> F.Column:
    return F.pmod(F.xxhash64("vec_id", F.lit(salt)), parts)


def meetings(blocks: DataFrame, sizes: DataFrame) -> DataFrame:
    """A copy of each block for each bucket it has to meet. blocks: dim, reach; sizes: dim, range, parts, longest, top."""
    few = sizes.count() <= BROADCAST_ROWS // 64
    able = blocks.join(F.broadcast(sizes) if few else sizes, (blocks["dim"] == sizes["dim"]) & (sizes["longest"] >= blocks["reach"])).drop(sizes["dim"])
    return able.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).filter(~F.col("top") | (F.col("part") > 0)).drop("parts", "longest", "top", "reach")


def search(spark: SparkSession, vectors: DataFrame, is_query: F.Column, k: int = K, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score. vectors: vec_id, embedding; is_query: which rows ask, by vec_id."""
    space = Workspace(spark, "topk")
    rows = space.write(integers(vectors, scale), "integers")
    n = rows.count()
    room = min(max(MOST_ROWS, BUCKET_ROWS), max(BUCKET_ROWS, n // RANGES))
    placed = rows.withColumn("range", _cuts(rows, "norm", min(RANGES, max(1, -(-n // room)))))
    sizes = placed.groupBy("dim", "range").agg(F.greatest(F.round(F.count(F.lit(1)) / room).cast("long"), F.lit(1)).alias("parts"), F.max("norm").alias("longest"))
    sizes = space.write(sizes.withColumn("top", F.col("range") == F.min("range").over(Window.partitionBy("dim"))), "sizes")
    few = sizes.count() <= BROADCAST_ROWS // 64
    dealt = placed.join(F.broadcast(sizes) if few else sizes, ["dim", "range"]).withColumn("part", _hashed("part", F.col("parts")))
    buckets = space.write(_blocks(dealt.select("dim", "range", "part", "vec_id", "vector", "norm"), ["dim", "range", "part"]), "buckets")
    asked = rows.filter(is_query)
    many = max(1, -(-asked.count() // BLOCK_QUERIES))
    queries = _blocks(asked.withColumn("block", _hashed("block", F.lit(many))), ["dim", "block"]).withColumnsRenamed({"ids": "q_ids", "data": "q_data"})
    # the bucket of the longest vectors of each dimension gives the floors
    seed = buckets.join(sizes.filter("top").select("dim", "range"), ["dim", "range"], "left_semi").filter("part = 0").select("dim", "ids", "data")
    first = queries.join(F.broadcast(seed) if seed.count() <= 8 else seed, "dim")  # a bucket has MOST_ROWS vectors at most
    first = space.write(first.select("q_ids", "q_data", "ids", "data").mapInArrow(_search(k), _PAIRS), "first")
    floors = first.groupBy(F.col("query_id").alias("vec_id")).agg(F.min("score").alias("low"), F.count(F.lit(1)).alias("n"))
    floored = asked.join(floors, "vec_id", "left").withColumn("low", F.when(F.col("n") >= k, F.col("low").cast("double")).otherwise(F.lit(LOW)))
    floored = space.write(floored.withColumn("reach", F.when((F.col("low") > 0) & (F.col("norm") > 0), F.col("low") * SLACK / F.col("norm")).otherwise(F.lit(-1.0))).drop("n"), "floored")
    zoned = floored.withColumn("zone", _cuts(floored, "reach", min(RANGES, many)))
    slots = zoned.groupBy("zone").agg(F.ceil(F.count(F.lit(1)) / BLOCK_QUERIES).alias("slots"))  # RANGES rows at most
    zoned = zoned.join(F.broadcast(slots), "zone").withColumn("slot", _hashed("slot", F.col("slots"))).drop("slots")
    blocks = _blocks(zoned, ["dim", "zone", "slot"], True).withColumnsRenamed({"ids": "q_ids", "data": "q_data"}).drop("zone", "slot")
    rest = meetings(blocks, sizes).join(buckets, ["dim", "range", "part"])
    pairs = rest.select("q_ids", "q_data", "floors", "ids", "data").mapInArrow(_search(k), _PAIRS).unionByName(first)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
