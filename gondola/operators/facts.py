"""Price facts at store grain, and the panel they are reduced to before anything expensive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.functions.codes import GLOBAL_GTIN, INTERNAL_LOCAL, RESTRICTED_LOCAL
from gondola.functions.stats import kind, median, quantiles
from gondola.operators.common import BANNER, DAY, STORE, pinned, provinces
from gondola.plans.context import BuildContext
from gondola.plans.registry import Tables, mart

GRAIN = ["snapshot_date", *STORE, "gtin14"]
NO_PROVINCE = "SIN_DATO"


@mart("fct_global_price_store_daily", ("fact_price", "build_inputs"), ("build_id", *GRAIN), fan_out=True)
def fct_global_price_store_daily(ctx: BuildContext, t: Tables) -> DataFrame:
    """A projection: the grain is checked beforehand (duplicate_grain), so nothing needs to be aggregated."""
    rows = pinned(ctx, t, "fact_price").filter((F.col("product_code_scope") == GLOBAL_GTIN) & F.col("precio_lista_valido")).dropna(subset=STORE)
    price, one = F.col("precio_lista"), F.lit(1).cast("long")
    return rows.select(*DAY, *STORE, "gtin14", "product_code_scope", price.alias("list_price"), price.alias("source_price_min"), price.alias("source_price_max"), one.alias("source_rows"), one.alias("distinct_source_prices"))


def duplicate_grain(prices: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Keys that more than one row has, with how many."""
    return prices.groupBy(*(keys or GRAIN)).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")


@mart("fct_local_price_store_daily", ("fact_price", "build_inputs"), (*DAY, *STORE, "id_producto", "product_code_scope"))
def fct_local_price_store_daily(ctx: BuildContext, t: Tables) -> DataFrame:
    """Codes that only one chain knows: medians of the price and of the reference price for each unit."""
    rows = pinned(ctx, t, "fact_price").filter(F.col("product_code_scope").isin(RESTRICTED_LOCAL, INTERNAL_LOCAL) & F.col("precio_lista_valido")).dropna(subset=STORE)
    unit = F.col("unidad_referencia")
    per = F.col("precio_referencia").cast("double") / F.nullif("cantidad_referencia", F.lit(0.0))
    key = F.md5(F.concat_ws("|", *BANNER, "id_producto"))
    return (
        rows.groupBy(*DAY, *STORE, "id_producto", "product_code_scope")
        .agg(
            F.max("producto_descripcion").alias("producto_descripcion"),
            F.max("marca").alias("marca"),
            median(F.col("precio_lista"), kind(rows, "precio_lista")).alias("list_price"),
            F.median(F.when(unit == "KG", per).when(unit == "G", per * 1000)).alias("reference_price_per_kg"),
            F.median(F.when(unit == "L", per).when(unit == "ML", per * 1000)).alias("reference_price_per_litre"),
            F.median(F.when(unit == "UN", per)).alias("reference_price_per_unit"),
            F.count(F.lit(1)).alias("source_rows"),
        )
        .withColumn("local_product_key", key)
    )


@mart("mart_price_product_daily", ("fct_global_price_store_daily", "dim_store_daily"), (*DAY, "gtin14", *BANNER, "provincia_codigo"))
def mart_price_product_daily(ctx: BuildContext, t: Tables) -> DataFrame:
    """Tenth, middle and ninetieth percentile of the prices of each product, banner and province, in one pass."""
    prices = t["fct_global_price_store_daily"]
    rows = prices.join(provinces(t), [*DAY, *STORE], "left").withColumn("provincia_codigo", F.coalesce("provincia_codigo", F.lit(NO_PROVINCE)))
    q = quantiles(F.col("list_price"), [0.10, 0.50, 0.90], kind(prices, "list_price"))
    out = rows.groupBy(*DAY, "gtin14", *BANNER, "provincia_codigo").agg(F.count(F.lit(1)).alias("reporting_stores"), F.min("list_price").alias("price_min"), F.max("list_price").alias("price_max"), q.alias("q"))
    return out.withColumns({"price_median": F.col("q")[1], "price_p10": F.col("q")[0], "price_p90": F.col("q")[2]}).drop("q")


@mart("bridge_analysis_product_daily", ("bridge_index_common_gtin_daily", "dim_basket_component", "dim_store_daily"), (*DAY, "gtin14"))
def bridge_analysis_product_daily(ctx: BuildContext, t: Tables) -> DataFrame:
    """The products that are analysed on each date: the common panel and the basket."""
    dates = t["dim_store_daily"].select(*DAY).distinct()  # a row for each date of the window
    basket = t["dim_basket_component"].select("build_id", "gtin14").join(F.broadcast(dates), "build_id")
    return t["bridge_index_common_gtin_daily"].select(*DAY, "gtin14").unionByName(basket.select(*DAY, "gtin14")).distinct()


@mart("fct_analysis_price_store_daily", ("fct_global_price_store_daily", "bridge_analysis_product_daily", "dim_store_daily"), (*DAY, *STORE, "gtin14"), fan_out=True)
def fct_analysis_price_store_daily(ctx: BuildContext, t: Tables) -> DataFrame:
    """Prices of the analysed products with the store's province."""
    prices = t["fct_global_price_store_daily"].select(*DAY, *STORE, "gtin14", "list_price")
    panel = prices.join(t["bridge_analysis_product_daily"], [*DAY, "gtin14"], "left_semi")
    return panel.join(provinces(t), [*DAY, *STORE], "left")
