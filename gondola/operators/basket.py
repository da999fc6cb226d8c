"""Cost of a fixed basket: candidates, components, stores, and summaries gated by completeness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.functions.stats import PUBLISHABLE, kind, quantiles, ratio, status, valid_geography
from gondola.operators.common import BANNER, DAY, STORE, latest, provinces
from gondola.operators.patterns import regex_join
from gondola.plans.context import BuildContext
from gondola.plans.registry import Tables, mart

VERSIONED = ["build_id", "basket_version", "snapshot_date"]


@mart("mart_basket_candidate_review", ("dim_basket_component", "dim_product_variant_asof"), ("build_id", "basket_version", "category_id", "gtin14"))
def mart_basket_candidate_review(ctx: BuildContext, t: Tables) -> DataFrame:
    """Variants whose description fits a category's patterns; a pattern is tried only where a piece of it occurs."""
    c = t["dim_basket_component"].withColumnRenamed("gtin14", "selected_gtin").select("build_id", "basket_version", "category_id", "selected_gtin", "target_quantity_base", "target_base_unit", "include_regex", "exclude_regex")
    rows = regex_join(t["dim_product_variant_asof"], c, "producto_descripcion_normalizada", "include_regex", "exclude_regex", ["build_id"])
    size = F.abs(F.col("cantidad_base") / F.nullif("target_quantity_base", F.lit(0.0)) - 1) <= ctx.thresholds.presentation_tolerance
    rows = rows.withColumns({"selected_component": F.col("gtin14") == F.col("selected_gtin"), "semantic_match": F.lit(True), "presentation_match": (F.col("unidad_base") == F.col("target_base_unit")) & size})
    # the published rule ranks a null comparison first, as its engine sorts nulls in descending order last: keep them last
    best = [F.desc_nulls_last((F.col("selected_component") & F.col("presentation_match")).cast("int")), F.desc("observations"), F.desc("producto_descripcion_normalizada"), *(F.desc_nulls_last(x) for x in ("producto_descripcion", "marca", "cantidad_base", "unidad_base"))]
    kept = latest(rows, ["build_id", "basket_version", "category_id", "gtin14"], best)
    return kept.select("build_id", "basket_version", "category_id", "gtin14", "producto_descripcion", "marca", "cantidad_base", "unidad_base", "selected_component", "semantic_match", "presentation_match")


@mart("mart_basket_component_store_daily", ("fct_analysis_price_store_daily", "dim_basket_component", "dim_basket_version"), (*VERSIONED, *STORE, "category_id"), fan_out=True)
def mart_basket_component_store_daily(ctx: BuildContext, t: Tables) -> DataFrame:
    """Component prices of the basket versions that are valid on the date; an open end is valid for ever."""
    versions = t["dim_basket_version"].filter("status = 'PUBLISHED'").select("build_id", "basket_version", "valid_from", "valid_to")
    parts = t["dim_basket_component"].select("build_id", "basket_version", "category_id", "category_name", "gtin14").join(F.broadcast(versions), ["build_id", "basket_version"])
    date = F.col("snapshot_date")
    rows = t["fct_analysis_price_store_daily"].join(F.broadcast(parts), ["build_id", "gtin14"]).filter((date >= F.col("valid_from")) & (F.col("valid_to").isNull() | (date <= F.col("valid_to"))))
    return rows.select(*VERSIONED, *STORE, "provincia_codigo", "category_id", "category_name", "gtin14", F.col("list_price").alias("component_cost"))


@mart("mart_basket_store_daily", ("fct_global_price_store_daily", "dim_basket_component", "mart_basket_component_store_daily", "dim_store_daily"), (*VERSIONED, *STORE), fan_out=True)
def mart_basket_store_daily(ctx: BuildContext, t: Tables) -> DataFrame:
    """Every active store and basket version: stores without components stay, with a null cost."""
    active = t["fct_global_price_store_daily"].select(*DAY, *STORE).distinct()
    expected = t["dim_basket_component"].groupBy("build_id", "basket_version").agg(F.count(F.lit(1)).alias("expected_components"))
    found = t["mart_basket_component_store_daily"].groupBy(*VERSIONED, *STORE).agg(F.sum("component_cost").alias("observed_cost"), F.count("category_id").alias("found_components"))
    rows = active.join(F.broadcast(expected), "build_id").join(found, [*VERSIONED, *STORE], "left").join(provinces(t), [*DAY, *STORE], "left").fillna(0, ["found_components"])
    have, all_ = F.col("found_components"), F.col("expected_components")
    return rows.select(*VERSIONED, *STORE, "provincia_codigo", "observed_cost", "found_components", "expected_components", ratio(have, all_).alias("basket_coverage"), (have == all_).alias("complete_basket"))


def _cost(df: DataFrame, where: Column, *names: str) -> list[Column]:
    """Mean, median and percentiles of complete baskets under the names given."""
    value, of = F.col("observed_cost"), kind(df, "observed_cost")
    q = quantiles(value, [0.5, 0.1, 0.9], of, where)
    every = [F.avg(F.when(where, value.cast("double"))), q[0], q[1], q[2]]
    return [c.alias(n) for c, n in zip(every, names)]


def _summary(ctx: BuildContext, t: Tables, by: list[str], province: bool) -> DataFrame:
    limits, stores, complete = ctx.thresholds, t["mart_basket_store_daily"], F.col("complete_basket")
    out = stores.groupBy(*VERSIONED, *by).agg(
        F.count(F.lit(1)).alias("active_stores"), F.count_if(complete).alias("complete_stores"), F.count_distinct(F.when(complete, F.concat_ws("|", *BANNER))).alias("complete_banners"),
        *_cost(stores, complete, "branch_mean_cost", "branch_median_cost", "cost_p10", "cost_p90"),
    )
    out = out.withColumn("completion_rate", ratio(F.col("complete_stores"), F.col("active_stores")))
    enough, some = F.col("complete_stores") >= limits.basket_stores, F.col("complete_stores") >= limits.basket_stores_directional
    if province and not set(BANNER) <= set(by):
        enough, some = enough & (F.col("complete_banners") >= limits.basket_banners), some & (F.col("complete_banners") >= limits.basket_banners_directional)
    invalid = ~valid_geography("provincia_codigo", limits.geography_prefix) if province else None
    return out.withColumn("coverage_status", status(enough, some, invalid))


@mart("mart_basket_banner_daily", ("mart_basket_store_daily",), (*VERSIONED, *BANNER))
def mart_basket_banner_daily(ctx: BuildContext, t: Tables) -> DataFrame:
    return _summary(ctx, t, BANNER, False).select(*VERSIONED, *BANNER, "active_stores", "complete_stores", "completion_rate", "branch_mean_cost", "branch_median_cost", "cost_p10", "cost_p90", "coverage_status")


@mart("mart_basket_province_daily", ("mart_basket_store_daily",), (*VERSIONED, "provincia_codigo"))
def mart_basket_province_daily(ctx: BuildContext, t: Tables) -> DataFrame:
    return _summary(ctx, t, ["provincia_codigo"], True).select(*VERSIONED, "provincia_codigo", "active_stores", "complete_stores", "complete_banners", "completion_rate", "branch_mean_cost", "branch_median_cost", "cost_p10", "cost_p90", "coverage_status")


@mart("mart_basket_banner_province_daily", ("mart_basket_store_daily",), (*VERSIONED, *BANNER, "provincia_codigo"))
def mart_basket_banner_province_daily(ctx: BuildContext, t: Tables) -> DataFrame:
    return _summary(ctx, t, [*BANNER, "provincia_codigo"], True).select(*VERSIONED, *BANNER, "provincia_codigo", "active_stores", "complete_stores", "branch_median_cost", "coverage_status")


@mart("mart_basket_national_daily", ("mart_basket_store_daily",), tuple(VERSIONED))
def mart_basket_national_daily(ctx: BuildContext, t: Tables) -> DataFrame:
    """The observed network; a day without complete stores keeps its row."""
    stores = t["mart_basket_store_daily"]
    counts = F.col("complete_basket") & valid_geography("provincia_codigo", ctx.thresholds.geography_prefix)
    return stores.groupBy(*VERSIONED).agg(
        F.count_if(counts).alias("complete_stores"), F.count_distinct(F.when(counts, F.col("provincia_codigo"))).alias("represented_provinces"), *_cost(stores, counts, "network_branch_mean", "network_branch_median"),
    ).withColumn("estimation_type", F.lit("OBSERVED_NETWORK_NOT_POPULATION_WEIGHTED"))


@mart("mart_basket_savings_daily", ("mart_basket_banner_daily", "mart_basket_province_daily"), (*VERSIONED, "comparison_level"))
def mart_basket_savings_daily(ctx: BuildContext, t: Tables) -> DataFrame:
    """Dearest less cheapest of the publishable medians, between banners and between provinces."""
    level = lambda name, label: t[name].filter(F.col("coverage_status") == PUBLISHABLE).select(*VERSIONED, F.lit(label).alias("comparison_level"), "branch_median_cost")
    both = level("mart_basket_banner_daily", "BANNER").unionByName(level("mart_basket_province_daily", "PROVINCE"))
    high, low = F.col("highest_cost"), F.col("lowest_cost")
    out = both.groupBy(*VERSIONED, "comparison_level").agg(F.max("branch_median_cost").alias("highest_cost"), F.min("branch_median_cost").alias("lowest_cost"))
    return out.withColumns({"potential_saving_amount": high - low, "potential_saving_pct": 100 * ratio(high - low, high)})
