"""Semantic layer: the calendar and the measures that dashboards group by.

A measure is a Column expression over one export. `measure` evaluates it for any grouping, on all dates, on the last
date of the whole table, or on the last publishable date (of the level, where a table has levels); grouping never
moves that date, but by banner the level is the banners'.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gondola.functions.stats import PUBLISHABLE
from gondola.plans.registry import Tables


def _safe(part: Column, whole: Column) -> Column:
    return part / F.nullif(whole.cast("double"), F.lit(0.0))


@dataclass(frozen=True)
class Measure:
    table: str
    value: Column
    #: all, last (date of the table) or publishable (last date with publishable rows)
    at: str = "all"
    where: Column | None = None
    #: The level that counts, with its own date, where the grouping is by banner
    by_banner: str | None = None


def measures() -> dict[str, Measure]:
    """The seventeen measures of the published model."""
    shown = F.col("coverage_status") == PUBLISHABLE
    healthy = F.count_if("source_healthy")
    return {
        "indice_precio": Measure("index_daily", F.median("price_index")),
        "gtin_comunes_ultimo_dia": Measure("index_daily", F.min("common_gtins"), "last"),
        "indice_semanal": Measure("index_7d", F.median("geometric_mean_index")),
        "sensibilidad_maxima": Measure("index_sensitivity", F.max("sensitivity_delta")),
        "costo_canasta_ultimo_corte": Measure("basket_banner", F.median("branch_median_cost"), "last", shown),
        "costo_canasta_provincia": Measure("basket_province", F.median("branch_median_cost"), "last", shown),
        "sucursales_canasta_completa": Measure("basket_banner", F.sum("complete_stores"), "last"),
        "completitud_canasta": Measure("basket_banner", _safe(F.sum("complete_stores"), F.sum("active_stores")), "last"),
        "ahorro_canasta": Measure("basket_savings", F.max("potential_saving_amount"), "last", F.col("comparison_level") == "BANNER"),
        "ahorro_canasta_porcentaje": Measure("basket_savings", F.max("potential_saving_pct") / 100, "last", F.col("comparison_level") == "BANNER"),
        "salud_cadena_dia": Measure("banner_health", _safe(healthy, F.count(F.lit(1))), "last"),
        "cobertura_tiendas": Measure("banner_health", F.median("store_coverage_ratio")),
        "precios_invalidos": Measure("source_health", F.sum("invalid_list_price_rows"), "last"),
        "dispersion_limpia": Measure("dispersion_entity", F.median("median_dispersion_clean"), "publishable", by_banner="BANNER"),
        "productos_dispersion_publicables": Measure("dispersion_entity", F.sum("publishable_products"), "publishable"),
        "fallas_altas": Measure("quality_checks", F.sum("failed_rows"), "all", F.col("severity") == "high"),
        "contribucion_driver_top_3": Measure("index_drivers", F.sum("contribution_log_points"), "last", F.col("driver_rank") <= 3),
    }


def measure(exports: Tables, name: str, by: list[str] | None = None, level: str | None = None) -> DataFrame:
    """The measure for each group; `level` picks the dispersion level, whose own last publishable date counts. By banner,
    a measure of several levels is that of the banners, at their own date."""
    m = measures()[name]
    if level is None and "banner_label" in (by or []):
        level = m.by_banner
    df = exports[m.table]
    if level is not None:
        df = df.filter(F.col("dispersion_level") == level)
    if m.at == "publishable":
        df = df.filter(F.col("coverage_status") == PUBLISHABLE)
    if m.at != "all" and m.where is None:  # by date first, of which the last is taken: one reading of the table
        daily = df.groupBy(*(by or []), "snapshot_date").agg(m.value.alias(name))
        if not by:
            return daily.agg(F.max_by(name, "snapshot_date").alias(name))
        last = F.max("snapshot_date").over(Window.partitionBy())  # over a row for each group and date
        return daily.withColumn("__last", last).filter("snapshot_date = __last").select(*by, name)
    if m.at != "all":
        df = df.join(F.broadcast(df.agg(F.max("snapshot_date").alias("snapshot_date"))), "snapshot_date", "left_semi")
    if m.where is not None:
        df = df.filter(m.where)
    return df.groupBy(*(by or [])).agg(m.value.alias(name))


def calendar(exports: Tables) -> DataFrame:
    """Contiguous dates from the first to the last of all tables, with year, month and weekday."""
    spans = [df.agg(F.min("snapshot_date").alias("a"), F.max("snapshot_date").alias("z")) for df in exports.values() if "snapshot_date" in df.columns]
    span = spans[0]
    for other in spans[1:]:
        span = span.unionByName(other)
    dates = span.agg(F.min("a").alias("a"), F.max("z").alias("z")).select(F.explode(F.sequence("a", "z")).alias("date"))
    return dates.select("date", F.year("date").alias("year"), F.month("date").alias("month"), F.date_format("date", "MMMM").alias("month_name"), F.date_format("date", "EEEE").alias("weekday"))


def on_calendar(exports: Tables, table: str) -> DataFrame:
    """Rows of a table with their date's attributes: many to one, from the calendar to the table."""
    return exports[table].join(F.broadcast(calendar(exports).withColumnRenamed("date", "snapshot_date")), "snapshot_date", "left")


def write_star(exports: Tables, folder: str) -> None:
    """Dated tables partitioned by their date, beside the calendar: a reader of a few dates opens those dates' files only."""
    calendar(exports).write.mode("overwrite").parquet(f"{folder}/calendar")
    for name, df in exports.items():
        if "snapshot_date" in df.columns:
            df.repartition("snapshot_date").write.mode("overwrite").partitionBy("snapshot_date").parquet(f"{folder}/{name}")


def read_star(spark: SparkSession, folder: str, table: str, where: Column) -> DataFrame:
    """Rows of a table on the calendar's dates for which a condition on the calendar holds, with the date's attributes.

    The dates that are left prune the table's folders while the query runs; the calendar is one row a day, so it is broadcast."""
    dates = spark.read.parquet(f"{folder}/calendar").filter(where).withColumnRenamed("date", "snapshot_date")
    return spark.read.parquet(f"{folder}/{table}").join(F.broadcast(dates), "snapshot_date")
