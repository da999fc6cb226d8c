"""Streaming intake: archives that land in a folder are loaded as they come.

`binaryFile` streams the names only; each micro-batch hands its archives to the batch loader, whose activation makes
a replay harmless: the same file again is no work.
"""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from gondola.plans.warehouse import Warehouse
from gondola.sources import snapshots


def watch(spark: SparkSession, raw: str, store: Warehouse, checkpoint: str, force: bool = False) -> StreamingQuery:
    names = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "sepa_*.zip").option("recursiveFileLookup", "true").load(raw).select("path", "modificationTime")

    def take(batch: DataFrame, _: int) -> None:
        for row in batch.orderBy("modificationTime", "path").collect():  # the archives of one batch: a name each
            path = row["path"].removeprefix("file:")
            snapshots.load(store, path, PurePosixPath(path).parent.name, force)

    return names.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def price_changes(prices: DataFrame, late: str = "3 days") -> DataFrame:
    """Streaming counterpart of the daily medians: windows of a day by product, closed by a watermark. prices:
    ts timestamp, gtin14, list_price."""
    daily = prices.withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "gtin14")
    return daily.agg(F.count(F.lit(1)).alias("observations"), F.min("list_price").alias("price_min"), F.max("list_price").alias("price_max"), F.percentile_approx("list_price", 0.5, 10_000).alias("price_median")).select(F.col("window.start").alias("day"), "gtin14", "observations", "price_min", "price_max", "price_median")
