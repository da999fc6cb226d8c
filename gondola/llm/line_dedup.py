"""Line deduplication against levelled sorted runs of line hashes, with DataFrame operations only.

A line's key is the line without white space (0x20, 0x09-0x0D) at its ends, A-Z lower-cased. Of a key of LEAST code
points or more, only the lines of the first document that holds it (the smallest doc_id) stay.

`LineIndex` keeps the keys seen so far as runs: tables of 128-bit hashes, bucketed and sorted by the hash. A new batch
becomes a sorted run of its own; a chain of merge anti-joins with the runs, bucket by bucket and without a shuffle of
any of them, leaves what the batch brings in, which is added as a run of level 0. Once a level has FANOUT runs, the next
batch first merges them into one run of the level above. Runs hold no key twice, so a batch meets few runs and each hash
is rewritten once for each level.

`dedup` feeds a table through an index in BATCHES batches of ascending doc_ids, whatever its size. Lines are hashed in
one pass over the texts and counted before any shuffle, so that a line which a third of all rows hold is one row for each
task. Hot lines meet the batch's repeated keys in a sort-merge join, whose hot partitions Spark splits; the places of
dropped lines, a few bytes each, then meet their texts.

Defined cases: a null or empty text is one empty line; white space alone is an empty key, too short to be dropped. A line
that repeats within its first document stays there each time. Rows of one doc_id are one document, and so are all rows
whose doc_id is null, which comes after all others. Repeated rows give repeated results. Very long texts and lines are
whole. An empty table gives an empty result. Input columns named like output columns are replaced, others stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.llm.common import Workspace, text_or_empty

#: Fewest code points of a key whose lines may be dropped.
LEAST = 10
#: Batches that a whole table is fed in, and runs of a level that are merged into one.
BATCHES, FANOUT = 4, 2
ADDED = ("n_lines", "n_dropped", "kept_text")
_WHITE = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEYS = ["h1", "h2"]


def line_key(line: Column) -> Column:
    bare = F.trim(line, F.lit(_WHITE))
    ascii_only = F.octet_length(bare) == F.char_length(bare)  # lower() is quicker, but goes beyond A-Z elsewhere
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def _hashes(of: Column) -> list[Column]:
    return [F.xxhash64(of).alias("h1"), F.xxhash64(F.lit(1), of).alias("h2")]


def _text_id() -> list[Column]:
    """Tells the texts of one doc_id apart."""
    return [F.xxhash64(text_or_empty()).alias("t1"), F.xxhash64(F.lit(1), text_or_empty()).alias("t2")]


def lines(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """doc_id, t1, t2 (the text), place (0-based), h1, h2 of all lines whose key is long enough."""
    rows = docs.select(F.col("doc_id").cast("long"), *_text_id(), F.posexplode(F.split(text_or_empty(), "\n")).alias("place", "line"))
    rows = rows.select("doc_id", "t1", "t2", "place", line_key(F.col("line")).alias("key")).filter(F.char_length("key") >= least)
    return rows.select("doc_id", "t1", "t2", "place", *_hashes(F.col("key")))


#: Bucketed scans stay bucketed, and tell that their files are sorted, so merges of runs neither shuffle nor sort.
_SCANS = {"spark.sql.legacy.bucketedTableScan.outputOrdering": "true", "spark.sql.sources.bucketing.autoBucketedScan.enabled": "false"}


@contextmanager
def _sorted_scans(spark: SparkSession) -> Iterator[None]:
    before = {key: spark.conf.get(key) for key in _SCANS}
    for key, value in _SCANS.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


class LineIndex:
    """Sorted runs of the line hashes of all batches so far, in levels.

    Batches must come in ascending order of doc_ids: what the index holds counts as earlier than what is added. Runs are
    tables in the shared folder; a batch's run is complete before the index names it, so a batch that fails can be added again.
    """

    def __init__(self, spark: SparkSession, space: Workspace, fanout: int = FANOUT):
        self.spark, self.space, self.fanout = spark, space, fanout
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = [[]]
        self._made = 0

    def add(self, batch: DataFrame) -> DataFrame:
        """Adds the lines (doc_id, t1, t2, place, h1, h2) of a batch; returns the lines to drop: doc_id, t1, t2, place."""
        with _sorted_scans(self.spark):
            self._compact()
            # min and max skip nulls; nulls count as one more document
            least = [F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.bool_or(F.col("doc_id").isNull()).alias("unnamed")]
            own = batch.groupBy(*KEYS).agg(*least)
            own = own.select(*KEYS, "first", ((F.col("first") != F.col("last")) | (F.col("unnamed") & F.col("first").isNotNull())).alias("shared"))
            mine = self._write(own.withColumn("shared", F.coalesce("shared", F.lit(False))).repartition(self.buckets, *KEYS))
            fresh = self._read(mine)
            for run in self._runs():
                fresh = fresh.join(self._read(run).select(*KEYS).hint("merge"), KEYS, "left_anti")
            new = self._write(fresh) if self._runs() else mine
            repeated = self._read(new).filter("shared").select(*KEYS, "first", F.lit(False).alias("known"))
            if new != mine:
                known = self._read(mine).select(*KEYS).join(self._read(new).select(*KEYS).hint("merge"), KEYS, "left_anti")
                repeated = repeated.unionByName(known.select(*KEYS, F.lit(None).cast("long").alias("first"), F.lit(True).alias("known")))
            repeated = self.space.write(repeated, f"repeated-{self._made}")
            gone = batch.join(repeated.hint("merge"), KEYS).filter(F.col("known") | ~F.col("doc_id").eqNullSafe(F.col("first")))
            gone = self.space.write(gone.select("doc_id", "t1", "t2", "place"), f"gone-{self._made}")
            self.space.drop(f"repeated-{self._made}")
            if new != mine:
                self._forget(mine)
            self.levels[0].append(new)
        return gone

    def close(self) -> None:
        for run in self._runs():
            self._forget(run)
        self.levels = [[]]

    def _runs(self) -> list[str]:
        return [run for level in self.levels for run in level]

    def _compact(self) -> None:
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fanout:
                full = self.levels[k]
                whole = self._read(full[0])
                for run in full[1:]:  # a merge of sorted runs, which share no key
                    other = self._read(run).toDF(*KEYS, "first2", "shared2").hint("merge")
                    whole = whole.join(other, KEYS, "full_outer").select(*KEYS, F.coalesce("first", "first2").alias("first"), F.coalesce("shared", "shared2").alias("shared"))
                merged = self._write(whole)
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k] = []
                self.levels[k + 1].append(merged)
                for run in full:
                    self._forget(run)

    def _write(self, rows: DataFrame) -> str:
        """A sorted run: one file for each bucket, if rows are dealt out as the buckets are."""
        self._made += 1
        name = f"run_{uuid.uuid4().hex}"
        writer = rows.write.bucketBy(self.buckets, *KEYS).sortBy(*KEYS)
        writer.format("parquet").option("compression", "zstd").option("path", f"{self.space.path}/{name}").saveAsTable(name)
        return name

    def _read(self, run: str) -> DataFrame:
        return self.spark.table(run)

    def _forget(self, run: str) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {run}")
        self.space.drop(run)


def _boundaries(docs: DataFrame, batches: int) -> list[int]:
    """At most batches - 1 doc_ids, ascending, that cut the documents into batches of about the same size."""
    cuts = docs.select(F.col("doc_id").cast("long")).agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)], 1000)).first()[0]
    return sorted(set(cuts or []))


def dropped(spark: SparkSession, docs: DataFrame, least: int = LEAST, batches: int = BATCHES) -> DataFrame:
    """The lines to drop: doc_id, t1, t2, place."""
    space = Workspace(spark, "lines")
    rows, cuts = lines(docs, least), _boundaries(docs, batches)
    batch = F.lit(0)
    for cut in cuts:
        batch = batch + (F.col("doc_id") > cut).cast("int")
    batch = F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(batch)
    rows, path = rows.withColumn("batch", batch), f"{space.path}/batches"
    rows.write.partitionBy("batch").option("compression", "zstd").parquet(path)
    fed = spark.read.schema(rows.schema).parquet(path)
    index, gone = LineIndex(spark, space), None
    present = {r.batch for r in fed.select("batch").distinct().collect()}
    for k in sorted(present):
        found = index.add(fed.filter(F.col("batch") == k).drop("batch"))
        gone = found if gone is None else gone.unionByName(found)
    index.close()
    space.drop("batches")
    return rows.select("doc_id", "t1", "t2", "place").limit(0) if gone is None else gone


def dedup(spark: SparkSession, docs: DataFrame, least: int = LEAST, batches: int = BATCHES) -> DataFrame:
    """docs with n_lines (before dropping), n_dropped and kept_text."""
    docs = docs.drop(*(c for c in docs.columns if c.lower() in ADDED))
    gone = dropped(spark, docs, least, batches)
    places = gone.groupBy("doc_id", "t1", "t2").agg(F.collect_set("place").alias("__gone")).toDF("__id", "__t1", "__t2", "__gone")
    rows = docs.withColumns(dict(zip(("__r1", "__r2"), _text_id()))).withColumn("__lines", F.split(text_or_empty(), "\n"))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__r1") == F.col("__t1")) & (F.col("__r2") == F.col("__t2"))
    rows = rows.join(places.hint("merge"), same, "left")
    # places that stay, by a set difference, so that long texts take linear time
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    kept = F.when(F.col("__gone").isNull(), F.array_join("__lines", "\n")).otherwise(F.array_join(F.transform(stay, lambda k: F.get("__lines", k)), "\n"))
    rows = rows.withColumns({"n_lines": F.size("__lines").cast("long"), "n_dropped": F.coalesce(F.size("__gone"), F.lit(0)).cast("long"), "kept_text": kept})
    return rows.select(*docs.columns, *ADDED)
