"""Dimensions: banners, stores, products, the index scope, the basket."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gondola.functions.codes import GLOBAL_GTIN
from gondola.functions.units import base_quantity, base_unit
from gondola.operators.common import BANNER, DAY, STORE, latest, pinned
from gondola.plans.context import BuildContext
from gondola.plans.registry import Tables, mart

# Fixed values of the published methodology: the index scope and the basket with its patterns.
SCOPE_VERSION = "IDX_GROCERY_7_V1"
SCOPE = [
    ("10", "1", "CARREFOUR", "Hipermercado Carrefour", "Bandera de mayor surtido"),
    ("12", "1", "COTO", "COTO", "Grupo independiente"),
    ("11", "2", "CHANGOMAS", "Changomas", "Bandera principal"),
    ("15", "1", "DIA", "DIA", "Formato descuento"),
    ("2", "1", "LA_ANONIMA", "La Anonima", "Cobertura regional amplia"),
    ("9", "3", "CENCOSUD", "Jumbo", "Mayor surtido del grupo"),
    ("13", "1", "COOPERATIVA_OBRERA", "Cooperativa Obrera", "Grupo independiente"),
]
BASKET_VERSION, BASKET_NAME, BASKET_FROM = "CANASTA_2026W31_V1", "Canasta comparable de supermercado", dt.date(2026, 7, 27)
BASKET_NOTE = "Ocho GTIN exactos; presentacion fija; sin promociones ni imputacion."
BASKET = [
    (1, "ACEITE", "Aceite de girasol", "07790272001029", "Aceite Natura girasol 1,5 L", 1500.0, "ML", r"ACEITE.*GIRASOL", r"OLIVA|MEZCLA|AEROSOL", "Presentacion exacta y alta cobertura"),
    (2, "ARROZ", "Arroz blanco", "07791120031557", "Arroz Ala blanco 1 kg", 1000.0, "G", r"(^| )ARROZ( |$).*(BLANCO|LARGO FINO)", r"INTEGRAL|PARBOIL|DORADO|PREPARADO|GALLET|TOST", "Arroz blanco sin preparacion"),
    (3, "AZUCAR", "Azucar blanca comun", "07792540250450", "Azucar Ledesma superior 1 kg", 1000.0, "G", r"(^| )AZUCAR( |$)", r"HILERET.*LIGHT|LIGHT|DIET|EDULCOR|ENDULZ|STEVIA|SUCRAL|MASCAB|NEGRA|RUBIA|IMPALPABLE|SIN AZUCAR|S/AZUCAR", "Excluye edulcorantes y variantes light"),
    (4, "CAFE", "Cafe tostado molido", "07790550022234", "Cafe Cabrales tostado molido 250 g", 250.0, "G", r"CAFE.*(TOSTADO.*)?MOLIDO", r"INSTANT|CAPSUL|SAQUIT|DESCAFEIN|MOCHA", "Forma de consumo homogenea"),
    (5, "FIDEOS", "Fideos secos", "07790070320285", "Fideos Favorita secos 500 g", 500.0, "G", r"FIDEO.*(SECO|SPAGHETTI)|FIDEOS.*SECOS", r"SOPA|RELLENO|RAVIO|CAPEL|ÑOQUI|FRESCO", "Pasta seca simple"),
    (6, "HARINA", "Harina de trigo 000", "07790070562258", "Harina Favorita 000 1 kg", 1000.0, "G", r"HARINA.*(TRIGO.*)?000([^0-9]|$)", r"0000|INTEGRAL|ORGANIC|PREMEZCLA|LEUDANTE", "Tipo 000 exacto"),
    # the two backslashes are the published pattern's: it asks for a literal one
    (7, "LECHE", "Leche entera UHT", "07790742363008", "Leche La Serenisima entera UHT 1 L", 1000.0, "ML", r"LECHE.*(ENTERA.*)?(UAT|UHT|LARGA VIDA|L\\.V|3%)", r"POLVO|INFANTIL|DESCREM|PARCIAL|SABORIZ", "Leche entera de larga vida"),
    (8, "YERBA", "Yerba mate tradicional", "07792710000182", "Yerba Amanda tradicional 500 g", 500.0, "G", r"YERBA.*MATE.*TRADICIONAL", r"SUAVE|HIERBAS|SERRANA|SABORIZ|COMPUESTA", "Yerba tradicional sin variantes"),
]


@mart("dim_banner_daily", ("commerce_snapshot", "build_inputs"), (*DAY, *BANNER))
def dim_banner_daily(ctx: BuildContext, t: Tables) -> DataFrame:
    rows = pinned(ctx, t, "commerce_snapshot").dropna(subset=BANNER)
    order = [F.desc_nulls_last("comercio_ultima_actualizacion"), F.desc("source_package"), F.desc_nulls_last("comercio_bandera_nombre"), F.desc_nulls_last("comercio_razon_social"), F.desc_nulls_last("comercio_cuit"), F.desc_nulls_last("comercio_bandera_url"), F.desc_nulls_last("comercio_version_sepa")]
    kept = latest(rows, ["snapshot_date", *BANNER], order)
    return kept.select(*DAY, *BANNER, "comercio_cuit", "comercio_razon_social", "comercio_bandera_nombre", "comercio_bandera_url", "comercio_ultima_actualizacion", "comercio_version_sepa")


@mart("dim_store_daily", ("store_snapshot", "build_inputs"), (*DAY, *STORE), fan_out=True)
def dim_store_daily(ctx: BuildContext, t: Tables) -> DataFrame:
    shown = ["sucursal_nombre", "sucursal_tipo", "calle", "numero", "latitud", "longitud", "barrio", "codigo_postal", "localidad", "provincia_codigo", "coordenadas_validas"]
    rows = pinned(ctx, t, "store_snapshot").dropna(subset=STORE)
    first = ["sucursal_nombre", "provincia_codigo"]
    order = [F.desc("source_package"), *(F.desc_nulls_last(c) for c in [*first, *(c for c in shown if c not in first)])]
    return latest(rows, ["snapshot_date", *STORE], order).select(*DAY, *STORE, *shown)


VARIANT = ["gtin14", "producto_descripcion", "producto_descripcion_normalizada", "marca", "cantidad_presentacion", "unidad_presentacion"]


@mart("agg_product_variant_daily", ("fact_price", "build_inputs"), (*DAY, *VARIANT))
def agg_product_variant_daily(ctx: BuildContext, t: Tables) -> DataFrame:
    """How often each date has a product in each of its writings: what the window's variants are summed from. Packages are counted
    first, as the greatest of strings is found by sorting, which is left to those counts."""
    rows = pinned(ctx, t, "fact_price").filter(F.col("product_code_scope") == GLOBAL_GTIN)
    counts = rows.groupBy(*DAY, *VARIANT, "source_package").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*DAY, *VARIANT).agg(F.sum("n").alias("observations"), F.max("source_package").alias("last_package"))


@mart("dim_product_variant_asof", ("agg_product_variant_daily",), ("build_id", *VARIANT))
def dim_product_variant_asof(ctx: BuildContext, t: Tables) -> DataFrame:
    variants = t["agg_product_variant_daily"].groupBy("build_id", *VARIANT).agg(F.sum("observations").alias("observations"), F.max("snapshot_date").alias("last_seen"), F.max("last_package").alias("last_package"))
    size, unit = F.col("cantidad_presentacion"), F.col("unidad_presentacion")
    return variants.withColumns({"cantidad_base": base_quantity(size, unit), "unidad_base": base_unit(unit)})


@mart("dim_product_asof", ("dim_product_variant_asof",), ("build_id", "gtin14"))
def dim_product_asof(ctx: BuildContext, t: Tables) -> DataFrame:
    order = [F.desc("observations"), F.desc("last_seen"), F.desc("last_package"), *(F.desc_nulls_last(c) for c in ("producto_descripcion_normalizada", "marca", "cantidad_presentacion", "unidad_presentacion", "producto_descripcion"))]
    kept = latest(t["dim_product_variant_asof"], ["build_id", "gtin14"], order).withColumn("as_of_date", F.lit(ctx.as_of))
    return kept.select("build_id", "as_of_date", *VARIANT, "cantidad_base", "unidad_base", "observations", "last_seen")


def _spark(t: Tables) -> SparkSession:
    return next(iter(t.values())).sparkSession


@mart("dim_banner_scope", (), ("build_id", "scope_version", *BANNER))
def dim_banner_scope(ctx: BuildContext, t: Tables) -> DataFrame:
    rows = [(ctx.build_id, SCOPE_VERSION, *row) for row in SCOPE]
    return _spark(t).createDataFrame(rows, "build_id string, scope_version string, id_comercio string, id_bandera string, corporate_group string, banner_label string, inclusion_reason string")


@mart("dim_basket_version", (), ("build_id", "basket_version"))
def dim_basket_version(ctx: BuildContext, t: Tables) -> DataFrame:
    row = (ctx.build_id, BASKET_VERSION, BASKET_NAME, BASKET_FROM, None, "PUBLISHED", "LIST", BASKET_NOTE)
    return _spark(t).createDataFrame([row], "build_id string, basket_version string, basket_name string, valid_from date, valid_to date, status string, price_type string, methodology_note string")


@mart("dim_basket_component", (), ("build_id", "basket_version", "category_id"))
def dim_basket_component(ctx: BuildContext, t: Tables) -> DataFrame:
    rows = [(ctx.build_id, BASKET_VERSION, *row) for row in BASKET]
    return _spark(t).createDataFrame(rows, "build_id string, basket_version string, component_order int, category_id string, category_name string, gtin14 string, canonical_product_name string, target_quantity_base double, target_base_unit string, include_regex string, exclude_regex string, selection_rationale string")
