"""Price anomalies: against other stores on the same day, and against the same store the day before."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gondola.functions.selection import quantiles_by
from gondola.functions.stats import outside
from gondola.operators.common import DAY, STORE
from gondola.plans.context import BuildContext
from gondola.plans.registry import Tables, mart

KEYS = [*DAY, *STORE, "gtin14"]
OUT = [*KEYS, "list_price", "benchmark_price", "price_ratio", "severity", "anomaly_type"]


def _severity(ctx: BuildContext, value: Column) -> Column:
    return F.when(outside(value, *ctx.thresholds.critical), "CRITICAL").otherwise("WARNING")


def cross_section(ctx: BuildContext, prices: DataFrame) -> DataFrame:
    """Prices far from the product's median over all stores; near a power of ten they look like a misplaced point. A staple's
    group is as large as the country, so its median is selected instead of gathered."""
    benchmark = quantiles_by(prices, [*DAY, "gtin14"], "list_price", [0.5]).select(*DAY, "gtin14", F.col("quantiles")[0].alias("benchmark_price"))
    rows = prices.join(benchmark, [*DAY, "gtin14"]).withColumn("price_ratio", F.col("list_price").cast("double") / F.nullif(F.col("benchmark_price").cast("double"), F.lit(0.0)))
    power = F.log10("price_ratio")
    shifted = (F.abs(F.round(power)) >= 1) & (F.abs(power - F.round(power)) <= math.log10(ctx.thresholds.scale_tolerance))
    rows = rows.filter(outside(F.col("price_ratio"), *ctx.thresholds.warning))
    return rows.withColumns({"severity": _severity(ctx, F.col("price_ratio")), "anomaly_type": F.when(shifted, "SCALE_FACTOR").otherwise("CROSS_SECTION_OUTLIER")}).select(*OUT)


def temporal_jump(ctx: BuildContext, prices: DataFrame) -> DataFrame:
    """Jumps from the previous date, if that is exactly one earlier: a gap suppresses the test."""
    series = Window.partitionBy("build_id", *STORE, "gtin14").orderBy("snapshot_date")
    rows = prices.withColumns({"previous_date": F.lag("snapshot_date").over(series), "previous_price": F.lag("list_price").over(series)})
    apart = F.year("snapshot_date") - F.year("previous_date") if ctx.unit == "year" else F.datediff("snapshot_date", "previous_date")
    rows = rows.filter((apart == 1) & (F.col("previous_price") > 0)).withColumn("price_ratio", F.col("list_price").cast("double") / F.col("previous_price").cast("double"))
    rows = rows.filter(outside(F.col("price_ratio"), *ctx.thresholds.warning)).withColumnRenamed("previous_price", "benchmark_price")
    return rows.withColumns({"severity": _severity(ctx, F.col("price_ratio")), "anomaly_type": F.lit("TEMPORAL_JUMP")}).select(*OUT)


@mart("quality_price_anomaly_daily", ("fct_analysis_price_store_daily",), (*KEYS, "anomaly_type"), fan_out=True, lag=1)
def quality_price_anomaly_daily(ctx: BuildContext, t: Tables) -> DataFrame:
    prices = t["fct_analysis_price_store_daily"].select(*KEYS, "list_price")
    return cross_section(ctx, prices).unionByName(temporal_jump(ctx, prices))
