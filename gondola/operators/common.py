"""Key sets and small helpers of the marts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.plans.context import BuildContext
from gondola.plans.registry import Tables

BANNER = ["id_comercio", "id_bandera"]
STORE = [*BANNER, "id_sucursal"]
DAY = ["build_id", "snapshot_date"]
SCOPED = ["build_id", "scope_version", "snapshot_date"]


def pinned(ctx: BuildContext, tables: Tables, source: str) -> DataFrame:
    """Rows of a source that belong to the runs this build has pinned, with build_id.

    The inputs are one row for each date of the window, so the hint is safe; the date prunes partitions.
    """
    inputs = tables["build_inputs"].filter(F.col("build_id") == ctx.build_id).select("ingest_run_id", "snapshot_date")
    rows = tables[source].filter(F.col("snapshot_date").between(F.lit(ctx.window_start), F.lit(ctx.as_of)))
    return rows.join(F.broadcast(inputs), ["ingest_run_id", "snapshot_date"], "left_semi").withColumn("build_id", F.lit(ctx.build_id))


def provinces(tables: Tables) -> DataFrame:
    """The province of each store and date, for a join on both. It has a row for each of them, which estimates from file sizes
    don't see (dates are multiplied after the scan), so it is shuffled, never broadcast through the driver."""
    return tables["dim_store_daily"].select(*DAY, *STORE, "provincia_codigo").hint("merge")


def latest(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row for each key: the first in this order, which must be total for the result to be stable."""
    from pyspark.sql import Window

    place = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__place", F.row_number().over(place)).filter("__place = 1").drop("__place")
