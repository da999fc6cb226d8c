"""Quality gates: a closed set of checks over a build, each a count of failed rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gondola.functions.codes import GLOBAL_GTIN
from gondola.functions.stats import PUBLISHABLE, valid_geography
from gondola.functions.text import matches
from gondola.operators.common import STORE
from gondola.plans.context import BuildContext
from gondola.plans.registry import Tables

HIGH, MEDIUM = "high", "medium"
GEOGRAPHY = ("mart_dispersion_entity_daily", "mart_basket_province_daily", "mart_basket_banner_province_daily")


#: Frames that gates aggregate: a table's name, or a frame made of several.
SOURCES: dict[str, Callable[[BuildContext, Tables], DataFrame]] = {}


@dataclass(frozen=True)
class Gate:
    name: str
    severity: str
    details: str
    #: A table, or a name in SOURCES, and the aggregate over it that counts what failed.
    source: str
    failed: Callable[[BuildContext], Column]


GATES: dict[str, Gate] = {}


def gate(name: str, severity: str, details: str, source: str, failed: Callable[[BuildContext], Column]) -> None:
    GATES[name] = Gate(name, severity, details, source, failed)


def source(f: Callable[[BuildContext, Tables], DataFrame]):
    SOURCES[f.__name__] = f
    return f


@source
def inputs(ctx: BuildContext, t: Tables) -> DataFrame:
    return t["build_inputs"].filter(F.col("build_id") == ctx.build_id)


@source
def log(ctx: BuildContext, t: Tables) -> DataFrame:
    return t["ingestion_log"].join(F.broadcast(inputs(ctx, t).select("ingest_run_id")), "ingest_run_id", "left_semi")


@source
def chosen(ctx: BuildContext, t: Tables) -> DataFrame:
    """The basket's components with whether their candidate fits."""
    keys = ["build_id", "basket_version", "category_id"]
    fits = t["mart_basket_candidate_review"].filter("selected_component").select(*keys, (F.col("semantic_match") & F.col("presentation_match")).alias("fits"))
    return t["dim_basket_component"].join(fits, keys, "left")


@source
def index_days(ctx: BuildContext, t: Tables) -> DataFrame:
    center = 100 * F.exp(F.avg(F.ln(F.col("price_index") / 100)))
    return t["mart_banner_index_daily"].groupBy("snapshot_date").agg(center.alias("center"), F.min("common_gtins").alias("least"), F.max("common_gtins").alias("most"))


@source
def published_provinces(ctx: BuildContext, t: Tables) -> DataFrame:
    parts = []
    for name in GEOGRAPHY:
        rows = t[name].filter(F.col("coverage_status") == PUBLISHABLE)
        if "dispersion_level" in rows.columns:
            rows = rows.filter(F.col("dispersion_level").isin("PROVINCE", "BANNER_PROVINCE"))
        parts.append(rows.select("provincia_codigo"))
    return reduce(DataFrame.unionByName, parts)


def _n() -> Column:
    return F.count(F.lit(1))


def _where(condition: Callable[[], Column]) -> Callable[[BuildContext], Column]:
    return lambda ctx: F.count_if(condition())


def _total(column: str) -> Callable[[BuildContext], Column]:
    return lambda ctx: F.sum(column)


def _bad_province(ctx: BuildContext) -> Column:
    return F.count_if(~valid_geography("provincia_codigo", ctx.thresholds.geography_prefix))


def _boundaries(ctx: BuildContext) -> Column:
    return F.when(F.min("snapshot_date").eqNullSafe(F.lit(ctx.window_start)) & F.max("snapshot_date").eqNullSafe(F.lit(ctx.as_of)), 0).otherwise(1)


def _stale(ctx: BuildContext) -> Column:
    age = (ctx.validation_date - ctx.as_of).days if ctx.validation_date else 0
    return F.max(F.lit(int(age > ctx.thresholds.stale_days)))


gate("build_input_count", HIGH, "A build needs a full window of snapshots.", "inputs", lambda ctx: F.abs(F.lit(ctx.days) - _n()))
gate("build_input_boundaries", HIGH, "The snapshots span the window.", "inputs", _boundaries)
gate("source_loaded_row_difference", HIGH, "Every row of a source is loaded.", "log", lambda ctx: F.sum(F.abs(F.coalesce("source_rows", F.lit(0)) - F.coalesce("loaded_rows", F.lit(0)))))
gate("ingestion_structural_status", HIGH, "Packages load, or are known to be empty.", "log", _where(lambda: ~F.col("status").isin("success", "source_empty")))
gate("comparable_key_null", HIGH, "Comparable prices have all keys.", "fct_global_price_store_daily", _where(lambda: F.greatest(*[F.col(c).isNull() for c in ("snapshot_date", *STORE, "gtin14")])))
gate("restricted_code_in_global_fact", HIGH, "Only global codes are compared.", "fct_global_price_store_daily", _where(lambda: F.col("product_code_scope") != GLOBAL_GTIN))
gate("daily_mart_date_count", HIGH, "The price mart covers the window.", "mart_price_product_daily", lambda ctx: F.abs(F.lit(ctx.days) - F.count_distinct("snapshot_date")))
gate("basket_component_count", HIGH, "The basket has its fixed number of components.", "dim_basket_component", lambda ctx: F.abs(F.lit(8) - F.greatest(_n(), F.lit(1))))  # an empty basket counts as one row
gate("basket_component_uniqueness", HIGH, "Categories and codes occur once in the basket.", "dim_basket_component", lambda ctx: 2 * _n() - F.count_distinct("category_id") - F.count_distinct("gtin14"))
gate("basket_selected_semantic_or_presentation_mismatch", HIGH, "Each component fits its category's patterns and size.", "chosen", _where(lambda: ~F.coalesce("fits", F.lit(False))))
gate("hileret_light_selected", HIGH, "A sweetener is no plain sugar.", "dim_basket_component", lambda ctx: F.count_if(matches(F.col("canonical_product_name"), "HILERET.*LIGHT")))
gate("index_common_panel_consistency", HIGH, "All banners have one panel each day.", "index_days", _where(lambda: F.col("least") != F.col("most")))
gate("index_geometric_center", HIGH, "The geometric mean of the indices is 100 each day.", "index_days", _where(lambda: F.abs(F.col("center") - 100) > 0.0001))
gate("index_output_nonempty", HIGH, "There is an index.", "index_days", lambda ctx: F.when(_n() == 0, 1).otherwise(0))
gate("published_invalid_geography", HIGH, "Nothing with an invalid province is published.", "published_provinces", _bad_province)
gate("known_empty_source_packages", MEDIUM, "Known empty packages lower coverage.", "log", _where(lambda: F.col("status") == "source_empty"))
gate("reconstructed_source_lines", MEDIUM, "Broken lines were joined and then met the contract.", "log", _total("reconstructed_lines"))
gate("unhealthy_snapshot_days", MEDIUM, "Days under the share of the window's median rows or stores.", "mart_snapshot_health", _where(lambda: ~F.col("source_healthy")))
gate("unhealthy_scope_banner_days", MEDIUM, "Banner-days under the share of their window's median.", "mart_banner_day_health", _where(lambda: ~F.col("source_healthy")))
gate("invalid_source_product_codes", MEDIUM, "Declared codes with a wrong form or check digit.", "mart_quality_daily", _total("invalid_code_rows"))
gate("invalid_list_prices", MEDIUM, "Prices that are missing, no numbers, or not above zero.", "mart_quality_daily", _total("invalid_list_price_rows"))
gate("source_null_keys", MEDIUM, "Rows without a required key, which are not compared.", "mart_quality_daily", _total("null_key_rows"))
gate("critical_price_anomalies", MEDIUM, "Prices beyond the critical ratios.", "quality_price_anomaly_daily", _where(lambda: F.col("severity") == "CRITICAL"))
gate("invalid_or_missing_geography", MEDIUM, "Stores without a valid province.", "dim_store_daily", _bad_province)
gate("stale_as_of_date", MEDIUM, "The last snapshot is old.", "dim_basket_component", _stale)


def quality_checks(ctx: BuildContext, t: Tables) -> DataFrame:
    """build_id, test_name, failed_rows, severity, details: one row for each gate, from one aggregate for each source."""
    by_source: dict[str, list[Gate]] = {}
    for g in GATES.values():
        by_source.setdefault(g.source, []).append(g)
    parts = []
    for name, own in by_source.items():
        rows = SOURCES[name](ctx, t) if name in SOURCES else t[name]
        row = lambda g: F.struct(F.lit(g.name).alias("test_name"), F.coalesce(F.col(g.name), F.lit(0)).cast("long").alias("failed_rows"), F.lit(g.severity).alias("severity"), F.lit(g.details).alias("details"))
        parts.append(rows.agg(*[g.failed(ctx).cast("long").alias(g.name) for g in own]).select(F.explode(F.array(*map(row, own))).alias("gate")))
    return reduce(DataFrame.unionByName, parts).select(F.lit(ctx.build_id).alias("build_id"), "gate.*")


def reads() -> list[str]:
    """The tables that the gates' aggregates read."""
    return sorted({g.source for g in GATES.values()} - set(SOURCES)) + ["build_inputs", "ingestion_log", "mart_basket_candidate_review", "mart_banner_index_daily", *GEOGRAPHY]


def missing_or_unknown(checks: DataFrame) -> set[str]:
    """Names on one side only: the set of gates is closed."""
    return {r["test_name"] for r in checks.select("test_name").collect()} ^ set(GATES)
