"""Equal-weight geometric price index on the products that all banners of the scope share."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gondola.functions.stats import geometric_mean, outside
from gondola.operators.common import BANNER, SCOPED
from gondola.plans.context import BuildContext
from gondola.plans.registry import Tables, mart

ENTITY = [*SCOPED, *BANNER]


@mart("bridge_index_common_gtin_daily", ("dim_banner_scope", "mart_banner_day_health", "mart_banner_product_daily"), (*SCOPED, "gtin14"))
def bridge_index_common_gtin_daily(ctx: BuildContext, t: Tables) -> DataFrame:
    """Relational division by counting: days on which all banners are healthy, products that all of them have."""
    expected = F.broadcast(t["dim_banner_scope"].groupBy("build_id", "scope_version").agg(F.count(F.lit(1)).alias("expected")))
    days = t["mart_banner_day_health"].groupBy(*SCOPED).agg(F.count_if("source_healthy").alias("healthy"))
    days = days.join(expected, ["build_id", "scope_version"]).filter("healthy = expected").select(*SCOPED, "expected")
    seen = t["mart_banner_product_daily"].groupBy(*SCOPED, "gtin14").agg(F.count(F.lit(1)).alias("observed"))
    return seen.join(F.broadcast(days), SCOPED).filter("observed = expected").select(*SCOPED, "gtin14")


@mart("mart_banner_index_relative_daily", ("mart_banner_product_daily", "bridge_index_common_gtin_daily"), (*ENTITY, "gtin14"), fan_out=True)
def mart_banner_index_relative_daily(ctx: BuildContext, t: Tables) -> DataFrame:
    """Price of each banner against the geometric mean of all, product by product. One shuffle serves join and window:
    a product's window holds one row for each banner of the scope."""
    panel = t["mart_banner_product_daily"].join(t["bridge_index_common_gtin_daily"], [*SCOPED, "gtin14"], "left_semi")
    product = Window.partitionBy(*SCOPED, "gtin14")
    price = F.col("banner_price").cast("double")
    rows = panel.withColumn("benchmark_price", F.exp(F.avg(F.ln(price)).over(product)))
    return rows.select(*ENTITY, "gtin14", "banner_price", "benchmark_price", (price / F.nullif("benchmark_price", F.lit(0.0))).alias("price_relative"))


@mart("mart_banner_index_daily", ("mart_banner_index_relative_daily", "mart_banner_product_daily"), tuple(ENTITY), fan_out=True)
def mart_banner_index_daily(ctx: BuildContext, t: Tables) -> DataFrame:
    catalog = t["mart_banner_product_daily"].groupBy(*ENTITY).agg(F.count(F.lit(1)).alias("catalog_gtins"))
    level = t["mart_banner_index_relative_daily"].groupBy(*ENTITY).agg((100 * geometric_mean(F.col("price_relative"))).alias("price_index"), F.count(F.lit(1)).alias("common_gtins"))
    share = 100.0 * F.col("common_gtins").cast("double") / F.nullif(F.col("catalog_gtins").cast("double"), F.lit(0.0))
    return level.join(catalog, ENTITY).withColumns({"shared_catalog_pct": share, "publishable": F.col("common_gtins") >= ctx.thresholds.index_panel})


@mart("mart_banner_index_7d", ("mart_banner_index_daily",), ("build_id", "scope_version", *BANNER))
def mart_banner_index_7d(ctx: BuildContext, t: Tables) -> DataFrame:
    value = F.col("price_index")
    return t["mart_banner_index_daily"].groupBy("build_id", "scope_version", *BANNER).agg(
        F.count(F.lit(1)).alias("observed_days"), (100 * geometric_mean(value / 100)).alias("geometric_mean_index"), F.min(value).alias("minimum_index"), F.max(value).alias("maximum_index"),
        F.stddev_samp(value).alias("index_stddev"), F.min("common_gtins").alias("minimum_common_gtins"), F.bool_and("publishable").alias("publishable_all_observed_days"),
    )


@mart("mart_banner_index_driver_daily", ("mart_banner_index_relative_daily",), (*ENTITY, "gtin14"))
def mart_banner_index_driver_daily(ctx: BuildContext, t: Tables) -> DataFrame:
    """What each product adds to its banner's index, in log points, ranked."""
    entity, log = Window.partitionBy(*ENTITY), F.ln("price_relative")
    return t["mart_banner_index_relative_daily"].withColumns({
        "contribution_log_points": 100.0 / F.count(F.lit(1)).over(entity) * log,
        "product_relative_pct": 100 * (F.col("price_relative") - 1),
        "driver_rank": F.row_number().over(entity.orderBy(F.desc(F.abs(log)), "gtin14")).cast("long"),
    })


@mart("mart_banner_index_sensitivity_daily", ("mart_banner_index_relative_daily",), tuple(ENTITY))
def mart_banner_index_sensitivity_daily(ctx: BuildContext, t: Tables) -> DataFrame:
    """The index as it is, without extreme relatives, and with these held at the limits."""
    low, high = ctx.thresholds.critical
    relative = F.col("price_relative")
    extreme = outside(relative, low, high)
    return t["mart_banner_index_relative_daily"].groupBy(*ENTITY).agg(
        F.count(F.lit(1)).alias("common_gtins"), (100 * geometric_mean(relative)).alias("raw_index"), (100 * geometric_mean(F.when(~extreme, relative))).alias("exclude_critical_index"),
        (100 * geometric_mean(F.greatest(F.lit(low), F.least(F.lit(high), relative)))).alias("winsorized_index"), F.count_if(extreme).alias("excluded_products"),
    )


@mart("mart_banner_pair_overlap_daily", ("mart_banner_product_daily",), (*SCOPED, "comercio_a", "bandera_a", "comercio_b", "bandera_b"))
def mart_banner_pair_overlap_daily(ctx: BuildContext, t: Tables) -> DataFrame:
    """Products that two banners share. Each product lists its banners (at most the scope's), whose ordered pairs are
    counted: one shuffle of the catalog instead of a self-join."""
    t_, catalog = ctx.thresholds, t["mart_banner_product_daily"].select(*ENTITY, "gtin14")
    name = F.struct(F.concat("id_comercio", F.lit("|"), "id_bandera").alias("n"), *BANNER)
    listed = catalog.groupBy(*SCOPED, "gtin14").agg(F.array_sort(F.collect_list(name)).alias("b"))
    pairs = F.flatten(F.transform("b", lambda a: F.transform(F.filter("b", lambda b: b["n"] > a["n"]), lambda b: F.struct(a["id_comercio"].alias("comercio_a"), a["id_bandera"].alias("bandera_a"), b["id_comercio"].alias("comercio_b"), b["id_bandera"].alias("bandera_b")))))
    shared = listed.select(*SCOPED, F.explode(pairs).alias("p")).groupBy(*SCOPED, "p.comercio_a", "p.bandera_a", "p.comercio_b", "p.bandera_b").agg(F.count(F.lit(1)).alias("common_gtins"))
    sizes = catalog.groupBy(*ENTITY).agg(F.count(F.lit(1)).alias("catalog"))
    for side in "ab":
        shared = shared.join(F.broadcast(sizes.toDF(*SCOPED, f"comercio_{side}", f"bandera_{side}", f"catalog_{side}")), [*SCOPED, f"comercio_{side}", f"bandera_{side}"])
    common, least = F.col("common_gtins").cast("double"), F.least("catalog_a", "catalog_b").cast("double")
    containment = 100.0 * common / least
    jaccard = 100.0 * common / (F.col("catalog_a") + F.col("catalog_b") - F.col("common_gtins")).cast("double")
    keys = [*SCOPED, "comercio_a", "bandera_a", "comercio_b", "bandera_b"]
    return shared.select(*keys, "common_gtins", "catalog_a", "catalog_b", containment.alias("containment_pct"), jaccard.alias("jaccard_pct"), ((F.col("common_gtins") >= t_.overlap_panel) & (containment >= t_.overlap_containment)).alias("publishable"))
