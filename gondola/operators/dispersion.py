"""Price dispersion at four grouping levels, with and without critical anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.functions.stats import DIRECTIONAL, PUBLISHABLE, kind, quantiles, ratio, status, valid_geography
from gondola.operators.common import BANNER, DAY, STORE
from gondola.plans.context import BuildContext
from gondola.plans.registry import Tables, mart

LEVELS = {"NATIONAL": [], "BANNER": BANNER, "PROVINCE": ["provincia_codigo"], "BANNER_PROVINCE": [*BANNER, "provincia_codigo"]}
ENTITY = [*DAY, "dispersion_level", *BANNER, "provincia_codigo"]


@mart("mart_price_dispersion_daily", ("fct_analysis_price_store_daily", "quality_price_anomaly_daily"), (*ENTITY, "gtin14"), fan_out=True)
def mart_price_dispersion_daily(ctx: BuildContext, t: Tables) -> DataFrame:
    """One grouping-sets pass over counts of equal prices, so that its four-fold expansion and its percentile buffers grow
    with the distinct prices of a banner and province, not with its stores. A rolled-up null and a store without a province are
    told apart by grouping()."""
    prices, limits = t["fct_analysis_price_store_daily"], ctx.thresholds
    keys = [*DAY, *STORE, "gtin14"]
    critical = t["quality_price_anomaly_daily"].filter("severity = 'CRITICAL'").select(*keys).distinct().withColumn("is_critical", F.lit(True))
    fixed = [*DAY, "gtin14"]
    base = prices.join(critical, keys, "left").groupBy(*fixed, *BANNER, "provincia_codigo", "list_price").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_critical").alias("bad"))
    base = base.withColumn("banner", F.concat_ws("|", *BANNER))
    sets = [[F.col(c) for c in [*fixed, *more]] for more in LEVELS.values()]
    price, of, good = F.col("list_price"), kind(prices, "list_price"), F.col("n") - F.col("bad")
    grouped = base.groupingSets(sets, *[F.col(c) for c in [*fixed, *BANNER, "provincia_codigo"]]).agg(
        F.grouping("id_comercio").alias("no_banner"), F.grouping("provincia_codigo").alias("no_province"),
        F.sum("n").alias("stores_raw"), F.sum(good).alias("stores_clean"),
        F.size(F.collect_set("banner")).cast("long").alias("banners"),  # few banners: cheaper than a distinct expansion
        quantiles(price, [0.5, 0.1, 0.9], of, times=F.col("n")).alias("raw"), quantiles(price, [0.5, 0.1, 0.9], of, good > 0, F.greatest(good, F.lit(1))).alias("clean"), F.sum("bad").alias("excluded_critical"),
    )
    level = F.when(F.col("no_banner") == 1, F.when(F.col("no_province") == 1, "NATIONAL").otherwise("PROVINCE")).otherwise(F.when(F.col("no_province") == 1, "BANNER").otherwise("BANNER_PROVINCE"))
    out = grouped.withColumn("dispersion_level", level)
    for name in ("raw", "clean"):
        out = out.withColumns({f"price_{p}_{name}": F.col(name)[k] for k, p in enumerate(("median", "p10", "p90"))})
        out = out.withColumn(f"dispersion_{name}", ratio(F.col(f"price_p90_{name}") - F.col(f"price_p10_{name}"), F.col(f"price_median_{name}")))
    by_province, by_banner = F.col("dispersion_level").isin("PROVINCE", "BANNER_PROVINCE"), F.col("dispersion_level").isin("BANNER", "BANNER_PROVINCE")
    enough = (F.col("stores_clean") >= limits.dispersion_stores) & (by_banner | (F.col("banners") >= limits.dispersion_banners))
    invalid = by_province & ~valid_geography("provincia_codigo", limits.geography_prefix)
    out = out.withColumn("coverage_status", status(enough, F.col("stores_clean") >= limits.dispersion_directional, invalid))
    prices_ = [f"price_{p}_{n}" for n in ("raw", "clean") for p in ("median", "p10", "p90")]
    return out.select(*DAY, "gtin14", "dispersion_level", *BANNER, "provincia_codigo", "stores_raw", "stores_clean", "banners", *prices_, "excluded_critical", "dispersion_raw", "dispersion_clean", "coverage_status")


@mart("mart_dispersion_entity_daily", ("mart_price_dispersion_daily",), tuple(ENTITY), fan_out=True)
def mart_dispersion_entity_daily(ctx: BuildContext, t: Tables) -> DataFrame:
    limits, publishable = ctx.thresholds, F.col("coverage_status") == PUBLISHABLE
    shown = F.col("coverage_status").isin(PUBLISHABLE, DIRECTIONAL)
    out = t["mart_price_dispersion_daily"].groupBy(*ENTITY).agg(
        F.count_if(publishable).alias("publishable_products"), F.median(F.when(publishable, F.col("dispersion_raw"))).alias("median_dispersion_raw"),
        F.median(F.when(publishable, F.col("dispersion_clean"))).alias("median_dispersion_clean"), F.sum("excluded_critical").alias("excluded_critical_prices"), F.count_if(shown).alias("shown"),
    )
    invalid = F.col("dispersion_level").isin("PROVINCE", "BANNER_PROVINCE") & ~valid_geography("provincia_codigo", limits.geography_prefix)
    return out.withColumn("coverage_status", status(F.col("publishable_products") >= limits.entity_publishable, F.col("shown") >= limits.entity_directional, invalid)).drop("shown")
