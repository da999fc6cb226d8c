"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A text's words (runs of bytes other than space and 0x09-0x0D, A-Z lower-cased) give shingles of three words; bit k
of the fingerprint is 1 if it is set in over half of the shingles' XXH64 hashes. Two fingerprints that differ in at
most r bits share a variant within r/2 flips of each. So every distinct fingerprint emits all variants within
r/2 flips, the variants are shuffled, and in each variant's group (at most 65 members for r = 2, as they are
distinct fingerprints around it) neighbours in sorted order become links once their distance is verified.
Members of a group lie within r of each other, so a chain of neighbours loses no component. Equal fingerprints are
one node, however many rows have them; components come from alternating stars (graph.py).

Defined cases: null and empty texts have no words, so fingerprint zero, which links like any other; fewer than three
words are one shingle; a null doc_id takes part but never names a component unless all of its rows are null.
Repeated rows give repeated results. dedup keeps one row of each component: of its smallest doc_id (null only if there is
no other), and of several texts with that id the one of the least SHA-256; other rows of that id stay or go with their
own component. An empty table gives an empty result; columns of docs may have any names and stay as they are.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gondola.llm.common import BROADCAST_ROWS, Workspace, in_slices, released, text_or_empty

#: Differing bits that still link.
DISTANCE = 2
SHINGLE = 3
SEED = 42
#: Hashes whose bits are counted at once (64 bytes each).
SLICE = 1 << 17


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # of bytes: ASCII letters and white space only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) <= size:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.r_[0, ends[: -size] + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[size - 1 :].tolist())), np.uint64, len(starts))


def _bits(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)


def simhash(texts: list[str | None]) -> np.ndarray:
    """Unsigned fingerprints."""
    return prints([shingle_hashes(t) for t in texts])


def prints(hashes: list[np.ndarray]) -> np.ndarray:
    """Fingerprints of the texts that have these shingle hashes."""
    out = np.zeros(len(hashes), np.uint64)
    weights = np.uint64(1) << np.arange(63, -1, -1, dtype=np.uint64)
    for run in in_slices([k for k, h in enumerate(hashes) if len(h)], lambda k: len(hashes[k]), SLICE):
        if len(run) == 1:
            h = hashes[run[0]]
            counts = sum(_bits(h[a : a + SLICE]).sum(axis=0, dtype=np.int64) for a in range(0, len(h), SLICE))[None]
        else:
            sizes = [len(hashes[k]) for k in run]
            counts = np.add.reduceat(_bits(np.concatenate([hashes[k] for k in run])), np.cumsum([0, *sizes[:-1]]), axis=0, dtype=np.int64)
        n = np.array([len(hashes[k]) for k in run])
        out[run] = ((2 * counts > n[:, None]) * weights).sum(axis=1, dtype=np.uint64)
    return out


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            part = batch.slice(a, 512)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(simhash(part.column(1).to_pylist()).view(np.int64))], names=["doc_id", "key", "fp"])


def text_key() -> F.Column:
    """Tells the texts of one doc_id apart; null and empty count as one."""
    return F.unhex(F.sha2(text_or_empty(), 256))


def fingerprints(docs: DataFrame, key: F.Column | None = None) -> DataFrame:
    """(doc_id, key, fp): the fingerprint's bits as a signed long; the key, if asked, tells rows apart."""
    key = F.lit(None).cast("binary") if key is None else key
    return docs.select(F.col("doc_id").cast("long"), "text", key.alias("key")).mapInArrow(released(_fingerprint), "doc_id long, key binary, fp long")


def masks(flips: int) -> list[int]:
    """All ways to flip at most so many of 64 bits, as signed longs."""
    every = [sum(1 << b for b in c) for n in range(flips + 1) for c in combinations(range(64), n)]
    return [m - (1 << 64) if m >> 63 else m for m in every]


def links(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """(a, b) between distinct fingerprints that connect all pairs within the distance. nodes: fp, distinct."""
    flips = F.array(*[F.lit(m).cast("long") for m in masks((distance + 1) // 2)])
    variants = nodes.select("fp", F.explode(flips).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    near = Window.partitionBy("variant").orderBy("fp")
    pairs = variants.select("fp", F.lag("fp").over(near).alias("other")).filter(F.col("other").isNotNull())
    return pairs.filter(F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= distance).select(F.col("fp").alias("a"), F.col("other").alias("b")).distinct()


def classes(spark: SparkSession, docs: DataFrame, distance: int = DISTANCE, key: F.Column | None = None) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id reachable), and key and root for without()."""
    if distance % 2:
        raise ValueError("an odd distance lets members of a variant's group be further apart than it")
    from gondola.llm.graph import components

    space = Workspace(spark, "simhash")
    rows = space.write(fingerprints(docs, key), "fingerprints")
    nodes = space.write(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    return named(space, rows, nodes, components(space, links(nodes.select("fp"), distance)))


def named(space: Workspace, rows: DataFrame, nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, key, fp, component_id, root (the same within a component only) of rows (doc_id, key, fp).

    nodes: fp, first; labels: node, label of the linked ones."""
    labels = labels.withColumnRenamed("node", "fp")
    labelled = space.write(nodes.join(labels, "fp"), "labelled")
    least = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    reached = space.write(labelled.join(least, "label").select("fp", "label", "component_id"), "reached")
    owners = nodes.join(reached, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"), F.coalesce("label", "fp").alias("root"))
    return rows.select("doc_id", "key", "fp").join(owners, "fp")


def dedup(spark: SparkSession, docs: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """The rows of docs that stay: one of each component, of the document that names it."""
    return without(spark, docs, classes(spark, docs, distance, text_key()))


def without(spark: SparkSession, docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of docs for each component. found: doc_id, key (text_key() of the row), root."""
    space = Workspace(spark, "one-each")
    kinds = space.write(found.groupBy("root", "doc_id", "key").agg(F.count(F.lit(1)).alias("n")), "kinds")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    kept = kinds.groupBy("root").agg(F.min(order).alias("first")).select("root", F.col("first.key").alias("own_key"), F.col("first.doc_id").alias("own_id"))
    marked = space.write(kinds.join(kept, "root").select("doc_id", "key", "n", (F.col("doc_id").eqNullSafe(F.col("own_id")) & (F.col("key") == F.col("own_key"))).alias("stays")), "marked")
    gone, often = marked.filter("NOT stays"), marked.filter("stays AND n > 1")

    def side(rows: DataFrame) -> DataFrame:
        few = rows.select(F.col("doc_id").alias("__id"), F.col("key").alias("__other"))
        return F.broadcast(few) if few.count() <= BROADCAST_ROWS else few

    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__key") == F.col("__other"))
    rest = docs.withColumn("__key", text_key()).join(side(gone), same, "left_anti")
    if often.isEmpty():
        return rest.select(*docs.columns)
    often = side(often)
    return rest.join(often, same, "left_anti").unionByName(rest.join(often, same, "left_semi").dropDuplicates(["doc_id", "__key"])).select(*docs.columns)
