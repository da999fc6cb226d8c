"""Views that consumers read: exports, large extracts, diagnostics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.functions.stats import DIRECTIONAL, PUBLISHABLE
from gondola.operators.common import BANNER, DAY
from gondola.plans.context import BuildContext
from gondola.plans.registry import Tables

View = Callable[[BuildContext, Tables], DataFrame]
VIEWS: dict[str, View] = {}
#: Extracts that are written as they are, compressed.
EXTRACTS = {"price_product_daily": "mart_price_product_daily", "basket_store_daily": "mart_basket_store_daily", "basket_component_store_daily": "mart_basket_component_store_daily", "product_dimension": "dim_product_asof", "store_dimension_daily": "dim_store_daily"}


def view(f: View) -> View:
    VIEWS[f.__name__] = f
    return f


def _plain(name: str, mart: str, *order: str) -> None:
    """A mart in the order of these columns; a minus in front turns one round."""

    def run(ctx: BuildContext, t: Tables) -> DataFrame:
        return t[mart].orderBy(*[down(c[1:]) if c[0] == "-" else up(c)[0] for c in order])

    run.__name__ = name
    view(run)


def up(*columns: str) -> list:
    return [F.asc_nulls_last(c) for c in columns]


def down(column: str):
    return F.desc_nulls_last(column)


def scoped_label(t: Tables, df: DataFrame) -> DataFrame:
    scope = t["dim_banner_scope"].select("build_id", "scope_version", *BANNER, "banner_label")
    return df.join(F.broadcast(scope), ["build_id", "scope_version", *BANNER], "left")


def any_label(t: Tables, df: DataFrame) -> DataFrame:
    """The scope's label of the banner, or else its name on that day."""
    names = t["dim_banner_daily"].select(*DAY, *BANNER, "comercio_bandera_nombre")
    scope = t["dim_banner_scope"].select("build_id", *BANNER, F.col("banner_label").alias("label"))
    rows = df.join(names, [*DAY, *BANNER], "left").join(F.broadcast(scope), ["build_id", *BANNER], "left")
    return rows.withColumn("banner_label", F.coalesce("label", "comercio_bandera_nombre")).select(*df.columns, "banner_label")


def described(t: Tables, df: DataFrame) -> DataFrame:
    return df.join(t["dim_product_asof"].select("build_id", "gtin14", "producto_descripcion", "marca"), ["build_id", "gtin14"], "left")


_plain("quality_daily", "mart_quality_daily", "snapshot_date")
_plain("quality_checks", "quality_checks", "severity", "test_name")
_plain("source_health", "mart_snapshot_health", "snapshot_date")
_plain("banner_health", "mart_banner_day_health", "snapshot_date", "banner_label")
_plain("banner_overlap", "mart_banner_pair_overlap_daily", "snapshot_date", "-common_gtins")
_plain("basket_province", "mart_basket_province_daily", "snapshot_date", "branch_median_cost")
_plain("basket_national", "mart_basket_national_daily", "snapshot_date")
_plain("basket_savings", "mart_basket_savings_daily", "snapshot_date", "comparison_level")


@view
def basket_definition(ctx: BuildContext, t: Tables) -> DataFrame:
    keys = ["build_id", "basket_version", "category_id", "gtin14"]
    chosen = t["mart_basket_candidate_review"].filter("selected_component").select(*keys, "producto_descripcion", "marca", "cantidad_base", "unidad_base")
    return t["dim_basket_component"].join(chosen, keys, "left").orderBy("component_order")


@view
def basket_candidate_review(ctx: BuildContext, t: Tables) -> DataFrame:
    rows = t["mart_basket_candidate_review"].filter("selected_component OR (semantic_match AND presentation_match)")
    return rows.orderBy(*up("category_id"), down("selected_component"), *up("gtin14"))


@view
def index_daily(ctx: BuildContext, t: Tables) -> DataFrame:
    return scoped_label(t, t["mart_banner_index_daily"]).orderBy(*up("snapshot_date", "price_index"))


@view
def index_7d(ctx: BuildContext, t: Tables) -> DataFrame:
    return scoped_label(t, t["mart_banner_index_7d"]).orderBy(*up("geometric_mean_index"))


@view
def index_sensitivity(ctx: BuildContext, t: Tables) -> DataFrame:
    rows = scoped_label(t, t["mart_banner_index_sensitivity_daily"])
    return rows.withColumn("sensitivity_delta", F.abs(F.col("raw_index") - F.col("exclude_critical_index"))).orderBy(*up("snapshot_date", "raw_index"))


@view
def index_drivers(ctx: BuildContext, t: Tables) -> DataFrame:
    rows = t["mart_banner_index_driver_daily"].filter(F.col("driver_rank") <= ctx.thresholds.drivers)
    return described(t, scoped_label(t, rows)).orderBy(*up("snapshot_date", "banner_label", "driver_rank"))


@view
def dispersion_entity(ctx: BuildContext, t: Tables) -> DataFrame:
    return any_label(t, t["mart_dispersion_entity_daily"]).orderBy(*up("snapshot_date", "dispersion_level"), down("median_dispersion_clean"))


@view
def dispersion_product_sample(ctx: BuildContext, t: Tables) -> DataFrame:
    """A sorted sample: the limit is the feature. Ties end in the key, so that it is stable."""
    rows = t["mart_price_dispersion_daily"].filter(F.col("coverage_status").isin(PUBLISHABLE, DIRECTIONAL))
    top = rows.orderBy(F.desc("snapshot_date"), down("dispersion_clean"), *up("gtin14", "dispersion_level", *BANNER, "provincia_codigo")).limit(ctx.thresholds.sample_rows)
    return described(t, top).orderBy(F.desc("snapshot_date"), down("dispersion_clean"))


@view
def basket_banner(ctx: BuildContext, t: Tables) -> DataFrame:
    return any_label(t, t["mart_basket_banner_daily"]).orderBy(*up("snapshot_date", "branch_median_cost"))


@view
def basket_banner_province(ctx: BuildContext, t: Tables) -> DataFrame:
    return any_label(t, t["mart_basket_banner_province_daily"]).orderBy(*up("snapshot_date", "provincia_codigo", "branch_median_cost"))


@view
def price_anomalies_sample(ctx: BuildContext, t: Tables) -> DataFrame:
    size = F.abs(F.ln("price_ratio"))
    order = [F.when(F.col("severity") == "CRITICAL", 1).otherwise(2), F.desc("snapshot_date"), F.desc_nulls_last(size)]
    top = t["quality_price_anomaly_daily"].orderBy(*order, *up("gtin14", *BANNER, "id_sucursal", "anomaly_type")).limit(ctx.thresholds.sample_rows)
    return described(t, top).orderBy(*order)


# Slices -----------------------------------------------------------------------------------------------------------------


def latest(df: DataFrame, date: str = "snapshot_date") -> DataFrame:
    last = df.agg(F.max(date).alias(date))
    return df.join(F.broadcast(last), date, "left_semi")


def latest_publishable(df: DataFrame, date: str = "snapshot_date") -> DataFrame:
    """Publishable rows of the last date that has some: the maximum is taken within them."""
    return latest(df.filter(F.col("coverage_status") == PUBLISHABLE), date)


def latest_publishable_level(df: DataFrame, level: str) -> DataFrame:
    return latest_publishable(df.filter(F.col("dispersion_level") == level))


def latest_index(df: DataFrame) -> DataFrame:
    return latest(df.filter("publishable"))


def extremes(df: DataFrame, value: str, *columns: str) -> DataFrame:
    """One row: the columns at the lowest and at the highest value."""
    row = F.struct(*columns, value)
    return df.agg(F.min_by(row, value).alias("low"), F.max_by(row, value).alias("high"))


def health_share(df: DataFrame) -> DataFrame:
    return df.agg(F.avg(F.col("source_healthy").cast("int")).alias("healthy_share"), F.count_if(~F.col("source_healthy")).alias("unhealthy"))


# Diagnostics ------------------------------------------------------------------------------------------------------------


def published_state(t: Tables) -> DataFrame:
    return t["warehouse_state"]


def last_publication(events: DataFrame, *order: str) -> DataFrame:
    """The publication that counts: one row of all, the greatest by these columns."""
    row = F.struct(*events.columns)
    return events.agg(F.max_by(row, F.struct(*order)).alias("last")).filter("last IS NOT NULL").select("last.*")


def inputs_of(ctx: BuildContext, t: Tables) -> DataFrame:
    return t["build_inputs"].filter(F.col("build_id") == ctx.build_id).orderBy("snapshot_date")


def failed_runs(t: Tables) -> DataFrame:
    return t["pipeline_runs"].filter(F.col("status") != "success").orderBy(F.desc("started_at"))


def ingestion_reconciliation(t: Tables) -> DataFrame:
    """Rows of the sources against rows loaded, by date and file."""
    log = t["ingestion_log"].join(t["snapshot_state"].select(F.col("active_ingest_run_id").alias("ingest_run_id")), "ingest_run_id", "left_semi")
    out = log.groupBy("snapshot_date", "file_name").agg(F.sum("source_rows").alias("source_rows"), F.sum("loaded_rows").alias("loaded_rows"), F.sum("footer_rows").alias("footer_rows"), F.sum("reconstructed_lines").alias("reconstructed_lines"), F.count_if(F.col("status") == "source_empty").alias("empty_packages"))
    return out.withColumn("difference", F.coalesce("source_rows", F.lit(0)) - F.coalesce("loaded_rows", F.lit(0))).orderBy("snapshot_date", "file_name")


def lineage_drift(ctx: BuildContext, t: Tables) -> DataFrame:
    """Dates whose active snapshot is no longer the one that was built from."""
    built = t["build_inputs"].filter(F.col("build_id") == ctx.build_id).select("snapshot_date", F.col("ingest_run_id").alias("built_run"), F.col("raw_sha256").alias("built_hash"))
    active = t["snapshot_state"].select("snapshot_date", F.col("active_ingest_run_id").alias("active_run"), F.col("raw_sha256").alias("active_hash"))
    return built.join(active, "snapshot_date", "left").filter(~F.col("built_run").eqNullSafe(F.col("active_run"))).orderBy("snapshot_date")


def unhealthy(t: Tables) -> DataFrame:
    return t["mart_banner_day_health"].filter("NOT source_healthy").orderBy("snapshot_date", *BANNER)


def failed_gates(t: Tables) -> DataFrame:
    return t["quality_checks"].filter("failed_rows > 0").orderBy("severity", F.desc("failed_rows"), "test_name")


def missing_index_dates(ctx: BuildContext, t: Tables) -> DataFrame:
    dates = t["build_inputs"].filter(F.col("build_id") == ctx.build_id).select("snapshot_date")
    return dates.join(t["mart_banner_index_daily"].select("snapshot_date").distinct(), "snapshot_date", "left_anti").orderBy("snapshot_date")


def index_centre(t: Tables) -> DataFrame:
    return t["mart_banner_index_daily"].groupBy("snapshot_date").agg((100 * F.exp(F.avg(F.ln(F.col("price_index") / 100)))).alias("center")).orderBy("snapshot_date")


def basket_validation(t: Tables) -> DataFrame:
    return t["mart_basket_store_daily"].groupBy("basket_version", "snapshot_date").agg(F.count(F.lit(1)).alias("stores"), F.count_if("complete_basket").alias("complete"), F.max("found_components").alias("most_components")).orderBy("snapshot_date")


def incomplete_baskets(stores: DataFrame) -> DataFrame:
    """How many stores of each banner miss how many components."""
    rows = stores.filter("NOT complete_basket").withColumn("missing_components", F.col("expected_components") - F.col("found_components"))
    return rows.groupBy("basket_version", "snapshot_date", *BANNER, "missing_components").agg(F.count(F.lit(1)).alias("stores"))


def dispersion_coverage(dispersion: DataFrame) -> DataFrame:
    return dispersion.groupBy("snapshot_date", "dispersion_level", "coverage_status").agg(F.count(F.lit(1)).alias("products"))
