"""Session defaults that the engine's semantics and plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.csv.parser.columnPruning.enabled": "false",  # else a count skips the field-count check
    "spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "100000",  # exact percentiles over many small groups
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.execution.arrow.maxBytesPerBatch": "8m",  # Python workers hold a batch whole; packages are rows of up to megabytes
}


def session(app: str = "gondola", master: str | None = None, **more: str) -> SparkSession:
    builder = SparkSession.builder.appName(app).config(map=SETTINGS | more)
    return (builder.master(master) if master else builder).getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """The settings that can change on a running session."""
    for key, value in SETTINGS.items():
        if spark.conf.isModifiable(key):
            spark.conf.set(key, value)
    return spark
