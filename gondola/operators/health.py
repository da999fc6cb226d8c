"""Coverage: daily quality counts, source health, banner health, persistence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gondola.functions.codes import GLOBAL_GTIN, INTERNAL_LOCAL, INVALID, RESTRICTED_LOCAL
from gondola.functions.stats import kind, median, ratio
from gondola.operators.common import BANNER, DAY, SCOPED, STORE, pinned
from gondola.plans.context import BuildContext
from gondola.plans.registry import Tables, mart


@mart("mart_quality_daily", ("fact_price", "build_inputs"), (*DAY,), fan_out=True)
def mart_quality_daily(ctx: BuildContext, t: Tables) -> DataFrame:
    rows, scope = pinned(ctx, t, "fact_price"), F.col("product_code_scope")
    of = lambda name: F.count_if(scope == name)
    missing = F.greatest(*[F.col(c).isNull() for c in (*STORE, "id_producto")])
    return rows.groupBy(*DAY).agg(
        F.count(F.lit(1)).alias("source_rows"),
        F.count_distinct(F.when(F.col("id_sucursal").isNotNull(), F.concat_ws("|", *STORE))).alias("reporting_stores"),
        F.count_distinct(F.when(scope == GLOBAL_GTIN, F.col("gtin14"))).alias("global_gtins"),
        of(GLOBAL_GTIN).alias("global_gtin_rows"),
        of(RESTRICTED_LOCAL).alias("restricted_local_rows"),
        of(INTERNAL_LOCAL).alias("internal_local_rows"),
        of(INVALID).alias("invalid_code_rows"),
        F.count_if(~F.col("precio_lista_valido")).alias("invalid_list_price_rows"),
        F.count_if(missing).alias("null_key_rows"),
        F.count_if(F.col("precio_promo_general") > 0).alias("general_promotion_rows"),
        F.count_if(F.col("precio_promo_segmentada") > 0).alias("segmented_promotion_rows"),
    )


def _against_window(ctx: BuildContext, df: DataFrame, by: list[str]) -> DataFrame:
    """Rows and stores of each date against their medians over the window. df is aggregated: a row for a date and key."""
    window = Window.partitionBy(*by)
    share = ctx.thresholds.health_share
    df = df.withColumns({"median_rows_7d": F.median("source_rows").over(window), "median_stores_7d": F.median("reporting_stores").over(window)})
    return df.withColumns({
        "row_coverage_ratio": ratio(F.col("source_rows"), F.col("median_rows_7d")),
        "store_coverage_ratio": ratio(F.col("reporting_stores"), F.col("median_stores_7d")),
        "source_healthy": (F.col("source_rows") >= share * F.col("median_rows_7d")) & (F.col("reporting_stores") >= share * F.col("median_stores_7d")),
    })


@mart("mart_snapshot_health", ("mart_quality_daily",), (*DAY,), windowed=("source_healthy",))
def mart_snapshot_health(ctx: BuildContext, t: Tables) -> DataFrame:
    return _against_window(ctx, t["mart_quality_daily"], ["build_id"])


@mart("mart_banner_day_health", ("fct_global_price_store_daily", "dim_banner_scope"), (*SCOPED, *BANNER), fan_out=True, windowed=("scope_version", *BANNER, "source_healthy"))
def mart_banner_day_health(ctx: BuildContext, t: Tables) -> DataFrame:
    """A row for every date of the window and banner of the scope, zero where nothing was reported."""
    actual = t["fct_global_price_store_daily"].groupBy("snapshot_date", *BANNER).agg(F.count(F.lit(1)).alias("source_rows"), F.count_distinct("id_sucursal").alias("reporting_stores"), F.count_distinct("gtin14").alias("reported_gtins"))
    step = F.expr("INTERVAL '1' YEAR" if ctx.unit == "year" else "INTERVAL '1' DAY")
    grid = t["dim_banner_scope"].select("build_id", "scope_version", *BANNER, "banner_label", F.explode(F.sequence(F.lit(ctx.window_start), F.lit(ctx.as_of), step)).alias("snapshot_date"))
    counts = ["source_rows", "reporting_stores", "reported_gtins"]
    dense = grid.join(actual, ["snapshot_date", *BANNER], "left").fillna(0, counts)
    out = _against_window(ctx, dense.select(*SCOPED, *BANNER, "banner_label", *counts), BANNER)
    return out.withColumn("source_healthy", F.col("source_healthy") & (F.col("reporting_stores") > 0))


@mart("mart_banner_product_daily", ("fct_global_price_store_daily", "dim_banner_scope", "mart_banner_day_health"), (*SCOPED, *BANNER, "gtin14"), fan_out=True)
def mart_banner_product_daily(ctx: BuildContext, t: Tables) -> DataFrame:
    """Median store price of each product and banner, on the banner's healthy days. The scope is small and known."""
    prices = t["fct_global_price_store_daily"]
    healthy = t["mart_banner_day_health"].filter("source_healthy").select(*SCOPED, *BANNER)
    rows = prices.join(F.broadcast(healthy), [*DAY, *BANNER])
    return rows.groupBy(*SCOPED, *BANNER, "gtin14").agg(median(F.col("list_price"), kind(prices, "list_price")).alias("banner_price"), F.count(F.lit(1)).alias("reporting_stores"))


@mart("mart_product_persistence_7d", ("mart_banner_product_daily", "mart_banner_day_health"), ("build_id", *BANNER, "gtin14"))
def mart_product_persistence_7d(ctx: BuildContext, t: Tables) -> DataFrame:
    health = t["mart_banner_day_health"].filter("source_healthy")
    days = health.groupBy("build_id", *BANNER).agg(F.count(F.lit(1)).alias("source_healthy_days"))
    stores = health.select(*DAY, *BANNER, F.col("reporting_stores").alias("all_stores"))
    daily = t["mart_banner_product_daily"].join(F.broadcast(stores), [*DAY, *BANNER]).withColumn("coverage", ratio(F.col("reporting_stores"), F.col("all_stores")))
    seen = daily.groupBy("build_id", *BANNER, "gtin14").agg(F.count(F.lit(1)).alias("observed_healthy_days"), F.median("coverage").alias("median_store_coverage"), F.min("coverage").alias("minimum_store_coverage"))
    observed, healthy = F.col("observed_healthy_days"), F.col("source_healthy_days")
    return seen.join(F.broadcast(days), ["build_id", *BANNER]).select(
        "build_id", F.lit(ctx.as_of).alias("window_end"), *BANNER, "gtin14", "source_healthy_days", "observed_healthy_days",
        ratio(observed, healthy).alias("conditional_persistence"), (observed / F.lit(float(ctx.days))).alias("calendar_persistence"),
        "median_store_coverage", "minimum_store_coverage", ((healthy == ctx.days) & (observed == ctx.days)).alias("strict_persistent_7d"),
    )
