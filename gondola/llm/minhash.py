"""Near-duplicates by the Jaccard similarity of word shingles: ball hashing of SimHash fingerprints and, beyond its radius,
MinHash bands propose pairs, exact similarity decides.

Words are those of simhash.py; a text is the set of XXH64 hashes of its five-word shingles, and texts of one set are
one node. Nodes whose fingerprints (of that set) ball hashing links, as in simhash.py, share a bucket. Two bits tell only
texts that are all but equal, so BANDS bands of ROWS least hashes each put nodes into further buckets: a
pair of similarity s shares one with probability 1 - (1 - s^ROWS)^BANDS, 0.9999 at 0.8. Every link is verified on the
whole texts.

Buckets may be large (a template, one text in many versions), so only those of FEW nodes are paired member by member:

1. neighbours in the order of set size are verified, in the balls and the buckets of the first FIRST bands, then in all
   buckets wherever neighbours are still apart: really alike nodes, however many, end up in few components, for a few
   verifications each;
2. in buckets of at most FEW nodes that still hold several components, all pairs that are apart and of like size are
   verified (at most FEW / 2 for a node and bucket);
3. nodes whose larger bucket holds several components go through an exact prefix filter: of a set's n shingles, in order of
   rarity among these nodes, the first n - ceil(0.8 n) + 1 are indexed, and nodes of different components are paired where
   they share one of them, and their sizes and its places in both orders allow the similarity. Two sets that are alike
   have such a shingle, the first they share; versions of a template that aren't alike have enough text of their own
   before it. Of those that share a shingle, each is
   first verified with the one that has the fewest rarer shingles, as it is like most of them; pairs follow only where
   nodes are still apart.

Pairs already within one component would add nothing, so no pair that shares a bucket is lost.

Defined cases: null and empty texts have no words and are one node, linked to no other; fewer than five words are one
shingle; null ids, repeated rows and ids, empty tables and extra columns are treated as in simhash.py.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gondola.llm.common import BROADCAST_ROWS, Workspace, in_slices, released
from gondola.llm.graph import components
from gondola.llm.simhash import DISTANCE, SEED, SLICE, named, prints, shingle_hashes, text_key, without
from gondola.llm.simhash import links as balls

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 30, 6
#: Bands whose neighbours are verified first.
FIRST = 2
#: Nodes of a bucket that are paired with each other.
FEW = 8
#: Hashes of sets that a task keeps for the next pairs, 16 MB; the sets of a pair come beside them.
HELD = 1 << 21
_RANDOM = np.random.default_rng(SEED)
_FLIP = _RANDOM.integers(0, 2**64, BANDS * ROWS, dtype=np.uint64)
_TIMES = _RANDOM.integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None) -> np.ndarray:
    return np.unique(shingle_hashes(text, SHINGLE))


def bands(sets: list[np.ndarray]) -> np.ndarray:
    """Bucket keys, BANDS for each of the sets (none empty)."""
    out = np.zeros((len(sets), BANDS), np.uint64)
    for run in in_slices(list(range(len(sets))), lambda k: len(sets[k]), SLICE):
        hashes, starts = np.concatenate([sets[k] for k in run]), np.cumsum([0, *(len(sets[k]) for k in run[:-1])])
        for band in range(BANDS):
            key = np.full(len(run), band + 1, np.uint64)
            for k in range(band * ROWS, (band + 1) * ROWS):
                key = (key ^ np.minimum.reduceat((hashes ^ _FLIP[k]) * _TIMES[k], starts)) * np.uint64(0x9E3779B97F4A7C15)
                key ^= key >> np.uint64(32)
            out[run, band] = key
    return out


def _describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, 512):
            part = batch.slice(a, 512)
            sets = [shingle_set(t) for t in part.column(1).to_pylist()]
            some = [k for k, s in enumerate(sets) if len(s)]
            keys = [[]] * len(sets)
            for k, row in zip(some, bands([sets[k] for k in some]).view(np.int64).tolist()):
                keys[k] = row
            own = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own), pa.array([len(s) for s in sets], pa.int64()), pa.array(prints(sets).view(np.int64)), pa.array(keys, pa.list_(pa.int64())), part.column(1), part.column(2)], names=["doc_id", "fp", "n", "sim", "bands", "text", "key"])


def buckets(space: Workspace, nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """band (0: the ball, from 1: MinHash), key, fp, n of nodes (fp, n, sim, bands) that have words."""
    some = nodes.filter("n > 0")
    stars = Workspace(space.spark, "minhash-balls")
    linked = space.write(components(stars, balls(some.select(F.col("sim").alias("fp")).distinct(), distance)), "balls")
    stars.close()
    placed = some.join(linked.toDF("sim", "ball"), "sim", "left").withColumn("ball", F.xxhash64(F.coalesce("ball", "sim")))
    return placed.select("fp", "n", F.posexplode(F.concat(F.array("ball"), "bands")).alias("band", "key"))


def _verify(similarity: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}  # the sets used last
        hashes = 0
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                a, b = part.column("a").to_pylist(), part.column("b").to_pylist()
                keep = []
                for k, ends in enumerate(zip(a, b)):
                    for fp, column in zip(ends, ("text_a", "text_b")):
                        own = held.pop(fp, None)
                        if own is None:
                            own = shingle_set(part.column(column)[k].as_py())
                            hashes += len(own)
                        held[fp] = own
                    x, y = held[ends[0]], held[ends[1]]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep.append(both >= similarity * (len(x) + len(y) - both) - 1e-9)
                    while hashes > HELD and len(held) > 2:
                        hashes -= len(held.pop(next(iter(held))))
                yield part.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _verified(space: Workspace, pairs: DataFrame, texts: DataFrame, similarity: float, name: str) -> DataFrame:
    """The pairs (a, b) of nodes that are similar."""
    pairs = space.write(pairs, f"{name}-pairs")
    ends = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    texts = space.write(texts.join(ends, "fp", "left_semi"), f"{name}-texts")
    joined = pairs.join(texts.toDF("a", "text_a"), "a").join(texts.toDF("b", "text_b"), "b")
    links = space.write(joined.mapInArrow(released(_verify(similarity)), "a long, b long"), f"{name}-links")
    space.drop(f"{name}-texts")
    return links


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for fp, text in zip(batch.column(0), batch.column(1)):
            own = shingle_set(text.as_py())
            for a in range(0, len(own), 1 << 16):
                part = own[a : a + (1 << 16)].view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), fp.as_py())), pa.array(part)], names=["fp", "shingle"])


def _prefixes(space: Workspace, left: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The prefixes of the nodes' shingles in order of rarity, without those of one node: key, fp, n, place (from 1)."""
    own = texts.join(left.select("fp"), "fp", "left_semi").select("fp", "text")
    held = space.write(own.mapInArrow(released(_shingles), "fp long, shingle long"), "shingles")
    common = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).filter("df > 1")  # a shingle of one node is the rarest, and pairs nothing
    rarity = Window.partitionBy("fp").orderBy("df", "shingle")
    ranked = held.join(common, "shingle", "left").select("fp", "shingle", F.coalesce("df", F.lit(1)).alias("df")).withColumn("place", F.row_number().over(rarity))
    least = F.col("n") - F.ceil(F.col("n") * similarity - 1e-9) + 1
    prefix = ranked.filter("df > 1").join(left, "fp").filter(F.col("place") <= least)
    prefixes = space.write(prefix.select(F.col("shingle").alias("key"), "fp", "n", "place"), "prefixes")
    space.drop("shingles")
    return prefixes


def _may_be_alike(similarity: float, n: str, place: str, n2: str, place2: str) -> F.Column:
    """Whether sets of these sizes may be similar if the shingle at these places is the first they share."""
    most = 1 + F.least(F.col(n) - F.col(place), F.col(n2) - F.col(place2))
    sizes = F.least(n, n2) >= similarity * F.greatest(n, n2) - 1e-9
    return sizes & (most * (1 + similarity) >= similarity * (F.col(n) + F.col(n2)) - 1e-9)


def classes(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, fp, component_id (the smallest doc_id reachable), and key and root for without()."""
    space = Workspace(spark, "minhash")
    described = docs.select(F.col("doc_id").cast("long"), "text", text_key().alias("key")).mapInArrow(released(_describe), "doc_id long, fp long, n long, sim long, bands array<long>, text string, key binary")
    rows = space.write(described, "rows")
    nodes = space.write(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.first("sim").alias("sim"), F.first("bands").alias("bands")), "nodes")
    order = Window.partitionBy("key").orderBy("n", "fp")
    spread = buckets(space, nodes).select("band", "key", "fp", "n", F.lag("fp").over(order).alias("before"), F.lead("fp").over(order).alias("after"))
    members = space.write(spread.filter("before IS NOT NULL OR after IS NOT NULL").select("band", "key", "fp", "n"), "members")

    some = members.select("fp").distinct()
    some = F.broadcast(some) if some.count() <= BROADCAST_ROWS else some
    texts = space.write(rows.join(some, "fp", "left_semi").groupBy("fp").agg(F.first("text").alias("text")), "texts")  # all that later steps read

    def neighbours(placed: DataFrame) -> DataFrame:
        """Neighbours in a bucket that are apart. placed: key, fp, n, label."""
        near = placed.select("fp", "n", "label", *[F.lag(c).over(order).alias(f"{c}_before") for c in ("fp", "n", "label")]).filter(F.col("fp_before").isNotNull())
        near = near.filter((F.col("label") != F.col("label_before")) & (F.col("n_before") >= similarity * F.col("n") - 1e-9))
        return near.select(F.least("fp", "fp_before").alias("a"), F.greatest("fp", "fp_before").alias("b")).distinct()

    def apart(index: DataFrame, links: DataFrame, name: str) -> DataFrame:
        """The rows of buckets that hold several components of the links, with label."""
        stars = Workspace(spark, f"minhash-{name}")
        labels = space.write(components(stars, links), f"{name}-labels").withColumnRenamed("node", "fp")
        stars.close()
        placed = space.write(index.join(labels, "fp", "left").select(*index.columns, F.coalesce("label", "fp").alias("label")), f"{name}-placed")
        mixed = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low <> high").select("key")
        found = space.write(placed.join(mixed, "key", "left_semi"), f"{name}-apart")
        for used in ("labels", "placed"):
            space.drop(f"{name}-{used}")
        return found

    def verified(pairs: DataFrame, name: str) -> DataFrame:
        """All links so far, with those among these pairs that haven't been tried."""
        nonlocal links, tried
        links = links.unionByName(_verified(space, pairs.join(tried, ["a", "b"], "left_anti"), texts, similarity, name))
        tried = tried.unionByName(spark.read.schema("a long, b long").parquet(f"{space.path}/{name}-pairs"))
        return links

    links = tried = spark.createDataFrame([], "a long, b long")
    alone = members.filter(F.col("band") <= FIRST).select("key", "fp", "n", F.col("fp").alias("label"))
    members = members.select("key", "fp", "n")
    verified(neighbours(alone), "first")
    verified(neighbours(apart(members, links, "first")), "near")
    mixed = apart(members, links, "near")
    few = mixed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") <= FEW).select("key")
    small = space.write(mixed.join(few, "key", "left_semi"), "small")
    other = small.toDF("key", "fp2", "n2", "label2")
    sizes = F.least("n", "n2") >= similarity * F.greatest("n", "n2") - 1e-9
    verified(small.join(other, "key").filter((F.col("fp") < F.col("fp2")) & (F.col("label") != F.col("label2")) & sizes).select(F.col("fp").alias("a"), F.col("fp2").alias("b")).distinct(), "few")
    left = space.write(mixed.join(few, "key", "left_anti").select("fp", "n").distinct(), "left")
    for used in ("members", "small", "near-apart"):
        space.drop(used)
    prefixes = _prefixes(space, left, texts, similarity)
    meet = (F.col("label") != F.col("label2")) & _may_be_alike(similarity, "n", "place", "n2", "place2")
    one = apart(prefixes, links, "left")
    centre = one.groupBy("key").agg(F.min(F.struct("place", "n", "fp", "label")).alias("c")).select("key", F.col("c.fp").alias("fp2"), F.col("c.n").alias("n2"), F.col("c.place").alias("place2"), F.col("c.label").alias("label2"))
    verified(one.join(centre, "key").filter(meet).select(F.least("fp", "fp2").alias("a"), F.greatest("fp", "fp2").alias("b")).distinct(), "centre")
    one = apart(prefixes, links, "centre")
    other = one.toDF("key", "fp2", "n2", "place2", "label2")
    verified(one.join(other, "key").filter((F.col("fp") < F.col("fp2")) & meet).select(F.col("fp").alias("a"), F.col("fp2").alias("b")).distinct(), "far")
    return named(space, rows, nodes, components(space, links))


def dedup(spark: SparkSession, docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The rows of docs that stay: one of each component, of the document that names it."""
    return without(spark, docs, classes(spark, docs, similarity))
