"""What the corpus operators share: tables, hand-over tables in shared storage, Arrow helpers."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import inspect
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a side whose every row is some tens of bytes that may be broadcast after counting it.
BROADCAST_ROWS = 400_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or one under the warehouse where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    set_one = spark.sparkContext.getCheckpointDir()
    return (set_one or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared").rstrip("/")


class Workspace:
    """A folder of hand-over tables in shared storage, removed when the JVM ends.

    A written table cuts the lineage: a lost executor costs a re-read, not a recomputation, and readers get
    sizes that Spark can plan with. Files are complete before anyone reads them.
    """

    def __init__(self, spark: SparkSession, name: str):
        bounded(spark)
        self.spark = spark
        self.path = f"{shared_dir(spark)}/gondola-{name}-{uuid.uuid4().hex}"
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(self.path)
        self.fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
        self.fs.mkdirs(hadoop)
        self.fs.deleteOnExit(hadoop)
        _made.append(self)

    def write(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.path}/{name}"
        df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)

    def close(self) -> None:
        """All tables go: whatever was read from them is written elsewhere."""
        self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(self.path), True)


_made: list[Workspace] = []


@contextlib.contextmanager
def transient() -> Iterator[None]:
    """Folders made within go at the end: whatever was read from them must be written elsewhere by then."""
    before = len(_made)
    try:
        yield
    finally:
        for space in _made[before:]:
            space.close()
        del _made[before:]


def bounded(spark: SparkSession) -> None:
    """Smaller Arrow batches than usual, as texts may be long, and shuffle files that go with the query that made them: what
    later steps need is written. A session that sets its own values keeps them."""
    for key, usual, own in (("spark.sql.execution.arrow.maxRecordsPerBatch", "10000", "2000"), ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false", "true")):
        if spark.conf.get(key, usual) == usual:
            spark.conf.set(key, own)


def released(f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """f, after whose end the worker gives its free memory back to the system: workers live on, beside the JVM."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from f(batches)
        gc.collect()
        _trim()

    return run


def trimmed(f: Callable[..., pa.Table]) -> Callable[..., pa.Table]:
    """The same for a function of one group, or of two."""

    def one(rows: pa.Table) -> pa.Table:
        out = f(rows)
        _trim()
        return out

    def two(left: pa.Table, right: pa.Table) -> pa.Table:
        out = f(left, right)
        _trim()
        return out

    return one if len(inspect.signature(f).parameters) == 1 else two


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # elsewhere than on glibc
        ctypes.CDLL(None).malloc_trim(0)


def text_or_empty(column: str = "text") -> F.Column:
    return F.coalesce(F.col(column), F.lit(""))


def id_bucket(column: str, modulus: int) -> F.Column:
    """crc32 of the decimal id, modulo; a null id counts as an empty string."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % modulus


def power_of_two(n: float) -> int:
    return 1 << max(0, int(n) - 1).bit_length()


def in_slices(rows: list, weight: Callable[[object], int], most: int) -> Iterator[list]:
    """Runs of rows whose weights sum to at most `most`; a heavier row comes alone."""
    run, total = [], 0
    for row in rows:
        w = weight(row)
        if run and total + w > most:
            yield run
            run, total = [], 0
        run.append(row)
        total += w
    if run:
        yield run


def record_batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], type=f.type) for f in schema], schema=schema)
