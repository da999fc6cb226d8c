"""Queries over the test tables, one or more for each family of operators, and the same in DuckDB SQL."""

from __future__ import annotations

import io
import uuid
import warnings
import zipfile
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gondola.functions import codes, text, units
from gondola.functions.selection import asked, picked, quantiles_by, ranged
from gondola.operators import bitmaps, dims, dispersion, facts, ranges, sketches
from gondola.operators.common import BANNER, latest
from gondola.operators.patterns import regex_join
from gondola.plans import exports, gates, registry, semantic
from gondola.plans.context import BuildContext
from gondola.plans.warehouse import Warehouse
from gondola.session import tune
from gondola.sources import adapter, snapshots
from gondola.sources.contract import COLUMNS
from gondola.streaming import jumps

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


#: Rows of a counted side that is broadcast.
FEW = 400_000

#: Added before a double is cut to six decimals: a half and a little, so that halves fall the same way in any engine.
HALF = 0.501


def tidy(df: DataFrame) -> DataFrame:
    """Without build_id, with doubles rounded: sums differ in their last bits between engines and partitionings."""
    df = df.drop("build_id")
    return df.select(*[(F.floor(F.col(c) * 1_000_000 + HALF) / F.lit(1e6)).alias(c) if kind == "double" else F.col(c).cast("long").alias(c) if kind in ("int", "tinyint", "smallint") else F.col(c) for c, kind in df.dtypes])


def _rounded(sql: str, shown: str = f"floor(({{}}) * 1000000 + {HALF}) / 1e6") -> str:
    """round(x, 6) as tidy does it, or in another form."""
    out = ""
    while (at := sql.find("round(")) >= 0:
        if at and sql[at - 1].isalnum():
            raise ValueError(sql[at - 5 : at + 9])
        depth, end = 1, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[end], 0)
            end += 1
        inner = sql[at + 6 : end - 1]
        if inner.endswith(", 6"):
            out, sql = out + sql[:at], shown.format(inner[:-3]) + sql[end:]
        else:
            out, sql = out + sql[: at + 6], sql[at + 6 :]
    return out + sql


def query(sql: str | None = None, name: str | None = None):
    def register(f: Query) -> Query:
        QUERIES[name or f.__name__] = lambda spark, sf_dir: f(tune(spark), sf_dir)
        if sql:
            ORACLES[name or f.__name__] = _rounded(sql)
        return f

    return register


def built(name: str, spark: SparkSession, sf_dir: str, banners: tuple[str, ...] = (), raw: bool = False) -> DataFrame:
    """raw: from the rows in raw shape, where the adapter has the mart itself."""
    ctx = adapter.context(spark, sf_dir)
    sources = adapter.sources(spark, sf_dir, ctx, banners)
    if raw:
        del sources[name]
    return registry.build(ctx, sources, {name}, keep=True)[name]


#: SQL of the mart queries, before rounding, for the views over them.
MART_SQL: dict[str, str] = {}


def mart_query(key: str, mart: str, sql: str, banners: tuple[str, ...] = (), where: str | None = None, raw: bool = False) -> None:
    MART_SQL[key] = sql

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = built(mart, spark, sf_dir, banners, raw)
        if "comercio_ultima_actualizacion" in df.columns:
            df = df.withColumn("comercio_ultima_actualizacion", F.col("comercio_ultima_actualizacion").cast("date").cast("string"))
        return tidy(df.filter(where) if where else df)

    run.__name__, run.__doc__ = key, f"{mart} on the adapter."
    query(sql, key)(run)


# The adapter in SQL -------------------------------------------------------------------------------------------------

_LINES = """
li AS (
  SELECT l.*, p.p_name, p.p_brand, p.p_size, p.p_type, r.r_name AS b, CAST(date_trunc('year', l_shipdate) AS DATE) AS d,
         CASE WHEN n_nationkey % 9 = 0 THEN n_name ELSE 'AR-' || n_name END AS p, CAST(l_suppkey AS VARCHAR) AS s, l_extendedprice / l_quantity AS x
  FROM lineitem l JOIN part p ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation n ON s_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey
)"""
_O = _LINES + """,
o AS (SELECT d, b, p, s, p_brand AS g, median(x) AS x FROM li GROUP BY ALL),
years AS (SELECT CAST(make_date(CAST(y AS INTEGER), 1, 1) AS DATE) AS d FROM range((SELECT min(year(d)) FROM o), (SELECT max(year(d)) + 1 FROM o)) t(y)),
st AS (SELECT CAST(s_suppkey AS VARCHAR) AS s, r_name AS b, CASE WHEN n_nationkey % 9 = 0 THEN n_name ELSE 'AR-' || n_name END AS p
       FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def _health(extra: str = "") -> str:
    return _O + f""",
scope AS (SELECT r_name AS b FROM region {extra}),
act AS (SELECT d, b, count(*) AS n, count(DISTINCT s) AS ns, count(DISTINCT g) AS ng FROM o GROUP BY ALL),
grid AS (SELECT y.d, c.b, coalesce(n, 0) AS n, coalesce(ns, 0) AS ns, coalesce(ng, 0) AS ng FROM years y CROSS JOIN scope c LEFT JOIN act a ON a.d = y.d AND a.b = c.b),
h AS (SELECT *, median(n) OVER (PARTITION BY b) AS mn, median(ns) OVER (PARTITION BY b) AS ms FROM grid),
hh AS (SELECT *, n >= 0.8 * mn AND ns >= 0.8 * ms AND ns > 0 AS ok FROM h),
bp AS (SELECT o.d, o.b, g, median(x) AS x, count(*) AS ns FROM o JOIN hh ON o.d = hh.d AND o.b = hh.b WHERE ok GROUP BY ALL)"""


_H = _health()
_REL = _H + """,
days AS (SELECT d FROM hh GROUP BY d HAVING count(*) FILTER (WHERE ok) = (SELECT count(*) FROM scope)),
panel AS (SELECT d, g FROM bp WHERE d IN (SELECT d FROM days) GROUP BY d, g HAVING count(*) = (SELECT count(*) FROM scope)),
bench AS (SELECT d, g, exp(avg(ln(x))) AS m FROM bp JOIN panel USING (d, g) GROUP BY d, g),
rel AS (SELECT d, b, g, x, m, x / m AS r FROM bp JOIN bench USING (d, g)),
idx AS (SELECT rel.d, rel.b, 100 * exp(avg(ln(r))) AS v, count(*) AS n, any_value(c.n) AS nc FROM rel JOIN (SELECT d, b, count(*) AS n FROM bp GROUP BY d, b) c ON rel.d = c.d AND rel.b = c.b GROUP BY rel.d, rel.b)"""
_BASKET_LIST = ", ".join(f"'{b}'" for b in adapter.BASKET)
_A = _REL + f""",
pan AS (SELECT d, g FROM panel UNION SELECT years.d, v.g FROM years CROSS JOIN (SELECT unnest([{_BASKET_LIST}]) AS g) v),
a AS (SELECT o.* FROM o JOIN pan USING (d, g)),
am AS (SELECT d, g, median(x) AS m FROM a GROUP BY d, g),
cs AS (SELECT a.*, m, x / m AS r FROM a JOIN am USING (d, g)),
lg AS (SELECT *, lag(d) OVER w AS pd, lag(x) OVER w AS px FROM a WINDOW w AS (PARTITION BY b, s, g ORDER BY d)),
an AS (
  SELECT d, b, s, g, x, m, r, CASE WHEN r NOT BETWEEN 0.5 AND 2 THEN 'CRITICAL' ELSE 'WARNING' END AS sev,
         CASE WHEN abs(round(log10(r))) >= 1 AND abs(log10(r) - round(log10(r))) <= log10(1.05) THEN 'SCALE_FACTOR' ELSE 'CROSS_SECTION_OUTLIER' END AS kind
  FROM cs WHERE r NOT BETWEEN 0.667 AND 1.5
  UNION ALL
  SELECT d, b, s, g, x, px, x / px, CASE WHEN x / px NOT BETWEEN 0.5 AND 2 THEN 'CRITICAL' ELSE 'WARNING' END, 'TEMPORAL_JUMP'
  FROM lg WHERE year(d) - year(pd) = 1 AND px > 0 AND x / px NOT BETWEEN 0.667 AND 1.5
)"""
_KEYS = "'REGIONS_5_V1' AS scope_version, d AS snapshot_date, b AS id_comercio, '1' AS id_bandera"
_ANOMALY = "SELECT d AS snapshot_date, b AS id_comercio, '1' AS id_bandera, s AS id_sucursal, g AS gtin14, round(x, 6) AS list_price, round(m, 6) AS benchmark_price, round(r, 6) AS price_ratio, sev AS severity, kind AS anomaly_type FROM an"
_D = _A + """,
crit AS (SELECT DISTINCT d, b, s, g FROM an WHERE sev = 'CRITICAL'),
base AS (SELECT a.*, c.g IS NOT NULL AS bad FROM a LEFT JOIN crit c ON a.d = c.d AND a.b = c.b AND a.s = c.s AND a.g = c.g),
gs AS (
  SELECT d, g, CASE WHEN grouping(b) = 1 AND grouping(p) = 1 THEN 'NATIONAL' WHEN grouping(p) = 1 THEN 'BANNER' WHEN grouping(b) = 1 THEN 'PROVINCE' ELSE 'BANNER_PROVINCE' END AS lv, b, p,
         count(*) AS n, count(*) FILTER (WHERE NOT bad) AS nc, count(DISTINCT b) AS nb, any_value(b) AS one_b,
         median(x) AS m0, quantile_cont(x, 0.1) AS l0, quantile_cont(x, 0.9) AS h0, median(x) FILTER (WHERE NOT bad) AS m1, quantile_cont(x, 0.1) FILTER (WHERE NOT bad) AS l1, quantile_cont(x, 0.9) FILTER (WHERE NOT bad) AS h1, count(*) FILTER (WHERE bad) AS ex
  FROM base GROUP BY GROUPING SETS ((d, g), (d, g, b), (d, g, p), (d, g, b, p))
),
disp AS (
  SELECT *, (h0 - l0) / m0 AS d0, (h1 - l1) / m1 AS d1,
         CASE WHEN lv IN ('PROVINCE', 'BANNER_PROVINCE') AND p NOT LIKE 'AR-%' THEN 'INVALID_GEOGRAPHY'
              WHEN lv IN ('NATIONAL', 'PROVINCE') AND nc >= 12 AND nb >= 3 THEN 'PUBLISHABLE' WHEN lv IN ('BANNER', 'BANNER_PROVINCE') AND nc >= 12 THEN 'PUBLISHABLE'
              WHEN nc >= 6 THEN 'DIRECTIONAL' ELSE 'SUPPRESSED' END AS st
  FROM gs
),
ent AS (
  SELECT d, lv, b, p, count(*) FILTER (WHERE st = 'PUBLISHABLE') AS n, median(d0) FILTER (WHERE st = 'PUBLISHABLE') AS d0, median(d1) FILTER (WHERE st = 'PUBLISHABLE') AS d1, sum(ex) AS ex,
         CASE WHEN lv IN ('PROVINCE', 'BANNER_PROVINCE') AND p NOT LIKE 'AR-%' THEN 'INVALID_GEOGRAPHY' WHEN count(*) FILTER (WHERE st = 'PUBLISHABLE') >= 15 THEN 'PUBLISHABLE'
              WHEN count(*) FILTER (WHERE st IN ('PUBLISHABLE', 'DIRECTIONAL')) >= 5 THEN 'DIRECTIONAL' ELSE 'SUPPRESSED' END AS st
  FROM disp GROUP BY d, lv, b, p
)"""
_ENTITY_OUT = "d AS snapshot_date, lv AS dispersion_level, b AS id_comercio, CASE WHEN b IS NOT NULL THEN '1' END AS id_bandera, p AS provincia_codigo, n AS publishable_products, round(d0, 6) AS median_dispersion_raw, round(d1, 6) AS median_dispersion_clean, CAST(ex AS BIGINT) AS excluded_critical_prices, st AS coverage_status"
_B = _O + f""",
comp AS (SELECT d, b, s, g, x FROM o WHERE g IN ({_BASKET_LIST}) AND year(d) > (SELECT min(year(d)) FROM o)),
bs AS (
  SELECT a.d, a.b, a.s, st.p, sum(c.x) AS cost, count(c.g) AS f FROM (SELECT DISTINCT d, b, s FROM o) a
  LEFT JOIN comp c ON a.d = c.d AND a.b = c.b AND a.s = c.s LEFT JOIN st ON st.s = a.s GROUP BY a.d, a.b, a.s, st.p
),
bb AS (SELECT d, b, count(*) AS n, count(*) FILTER (WHERE f = 8) AS c, avg(cost) FILTER (WHERE f = 8) AS av, median(cost) FILTER (WHERE f = 8) AS md, quantile_cont(cost, 0.1) FILTER (WHERE f = 8) AS lo, quantile_cont(cost, 0.9) FILTER (WHERE f = 8) AS hi FROM bs GROUP BY d, b),
bpv AS (SELECT d, p, count(*) AS n, count(*) FILTER (WHERE f = 8) AS c, count(DISTINCT b) FILTER (WHERE f = 8) AS nb, avg(cost) FILTER (WHERE f = 8) AS av, median(cost) FILTER (WHERE f = 8) AS md, quantile_cont(cost, 0.1) FILTER (WHERE f = 8) AS lo, quantile_cont(cost, 0.9) FILTER (WHERE f = 8) AS hi FROM bs GROUP BY d, p),
sb AS (SELECT *, CASE WHEN c >= 14 THEN 'PUBLISHABLE' WHEN c >= 4 THEN 'DIRECTIONAL' ELSE 'SUPPRESSED' END AS st FROM bb),
sp AS (SELECT *, CASE WHEN p NOT LIKE 'AR-%' THEN 'INVALID_GEOGRAPHY' WHEN c >= 14 AND nb >= 1 THEN 'PUBLISHABLE' WHEN c >= 4 AND nb >= 1 THEN 'DIRECTIONAL' ELSE 'SUPPRESSED' END AS st FROM bpv)"""
_COST = "n AS active_stores, c AS complete_stores, {more}round(c / n, 6) AS completion_rate, round(av, 6) AS branch_mean_cost, round(md, 6) AS branch_median_cost, round(lo, 6) AS cost_p10, round(hi, 6) AS cost_p90, st AS coverage_status"
_V = "'B1' AS basket_version, d AS snapshot_date"

# Marts ----------------------------------------------------------------------------------------------------------------

mart_query("price_index_daily", "mart_banner_index_daily", f"WITH {_REL} SELECT {_KEYS}, round(v, 6) AS price_index, n AS common_gtins, nc AS catalog_gtins, round(100.0 * n / nc, 6) AS shared_catalog_pct, n >= 24 AS publishable FROM idx")
mart_query("common_panel", "bridge_index_common_gtin_daily", f"WITH {_REL} SELECT 'REGIONS_5_V1' AS scope_version, d AS snapshot_date, g AS gtin14 FROM panel")
mart_query("price_relatives", "mart_banner_index_relative_daily", f"WITH {_REL} SELECT {_KEYS}, g AS gtin14, round(x, 6) AS banner_price, round(m, 6) AS benchmark_price, round(r, 6) AS price_relative FROM rel")
mart_query("price_index_window", "mart_banner_index_7d", f"WITH {_REL} SELECT 'REGIONS_5_V1' AS scope_version, b AS id_comercio, '1' AS id_bandera, count(*) AS observed_days, round(100 * exp(avg(ln(v / 100))), 6) AS geometric_mean_index, round(min(v), 6) AS minimum_index, round(max(v), 6) AS maximum_index, round(stddev_samp(v), 6) AS index_stddev, min(n) AS minimum_common_gtins, bool_and(n >= 24) AS publishable_all_observed_days FROM idx GROUP BY b")
mart_query("index_drivers_topk", "mart_banner_index_driver_daily", f"WITH {_REL} SELECT {_KEYS}, g AS gtin14, round(x, 6) AS banner_price, round(m, 6) AS benchmark_price, round(r, 6) AS price_relative, round(100.0 / count(*) OVER (PARTITION BY d, b) * ln(r), 6) AS contribution_log_points, round(100 * (r - 1), 6) AS product_relative_pct, row_number() OVER (PARTITION BY d, b ORDER BY abs(ln(r)) DESC, g) AS driver_rank FROM rel QUALIFY driver_rank <= 15", where="driver_rank <= 15")
mart_query("index_sensitivity", "mart_banner_index_sensitivity_daily", f"WITH {_REL} SELECT {_KEYS}, count(*) AS common_gtins, round(100 * exp(avg(ln(r))), 6) AS raw_index, round(100 * exp(avg(ln(r)) FILTER (WHERE r BETWEEN 0.5 AND 2)), 6) AS exclude_critical_index, round(100 * exp(avg(ln(greatest(0.5, least(2, r))))), 6) AS winsorized_index, count(*) FILTER (WHERE r NOT BETWEEN 0.5 AND 2) AS excluded_products FROM rel GROUP BY d, b")
mart_query("pair_overlap", "mart_banner_pair_overlap_daily", f"""WITH {_H}, c AS (SELECT d, b, count(*) AS n FROM bp GROUP BY d, b),
pr AS (SELECT x.d, x.b AS a, y.b AS z, count(*) AS n FROM bp x JOIN bp y ON x.d = y.d AND x.g = y.g AND x.b < y.b GROUP BY ALL)
SELECT 'REGIONS_5_V1' AS scope_version, pr.d AS snapshot_date, a AS comercio_a, '1' AS bandera_a, z AS comercio_b, '1' AS bandera_b, pr.n AS common_gtins, ca.n AS catalog_a, cz.n AS catalog_b,
round(100.0 * pr.n / least(ca.n, cz.n), 6) AS containment_pct, round(100.0 * pr.n / (ca.n + cz.n - pr.n), 6) AS jaccard_pct, pr.n >= 24 AND 100.0 * pr.n / least(ca.n, cz.n) >= 90 AS publishable
FROM pr JOIN c ca ON ca.d = pr.d AND ca.b = a JOIN c cz ON cz.d = pr.d AND cz.b = z""")
mart_query("product_persistence", "mart_product_persistence_7d", f"""WITH {_H}, hd AS (SELECT b, count(*) FILTER (WHERE ok) AS n FROM hh GROUP BY b), dy AS (SELECT bp.*, bp.ns / hh.ns AS cov FROM bp JOIN hh USING (d, b))
SELECT (SELECT max(d) FROM years) AS window_end, dy.b AS id_comercio, '1' AS id_bandera, g AS gtin14, any_value(hd.n) AS source_healthy_days, count(*) AS observed_healthy_days, round(count(*) / any_value(hd.n), 6) AS conditional_persistence,
round(count(*) / (SELECT count(*) FROM years), 6) AS calendar_persistence, round(median(cov), 6) AS median_store_coverage, round(min(cov), 6) AS minimum_store_coverage, any_value(hd.n) = (SELECT count(*) FROM years) AND count(*) = (SELECT count(*) FROM years) AS strict_persistent_7d
FROM dy JOIN hd ON hd.b = dy.b GROUP BY dy.b, g""")
mart_query("banner_day_health_grid", "mart_banner_day_health", f"""WITH {_health("UNION ALL SELECT 'ATLANTIS'")} SELECT {_KEYS}, upper(b[1]) || lower(b[2:]) AS banner_label, n AS source_rows, ns AS reporting_stores, ng AS reported_gtins, round(mn, 6) AS median_rows_7d, round(ms, 6) AS median_stores_7d,
round(n / nullif(mn, 0), 6) AS row_coverage_ratio, round(ns / nullif(ms, 0), 6) AS store_coverage_ratio, ok AS source_healthy FROM hh""".replace("upper(b[1]) || lower(b[2:]) AS banner_label", "list_aggregate(list_transform(string_split(b, ' '), lambda w: upper(w[1]) || lower(w[2:])), 'string_agg', ' ') AS banner_label"), banners=("ATLANTIS",))
mart_query("banner_product_prices", "mart_banner_product_daily", f"WITH {_H} SELECT {_KEYS}, g AS gtin14, round(x, 6) AS banner_price, ns AS reporting_stores FROM bp")
mart_query("price_quantiles", "mart_price_product_daily", f"WITH {_O} SELECT d AS snapshot_date, g AS gtin14, b AS id_comercio, '1' AS id_bandera, p AS provincia_codigo, count(*) AS reporting_stores, round(min(x), 6) AS price_min, round(max(x), 6) AS price_max, round(median(x), 6) AS price_median, round(quantile_cont(x, 0.1), 6) AS price_p10, round(quantile_cont(x, 0.9), 6) AS price_p90 FROM o GROUP BY d, g, b, p")
mart_query("analysis_bridge_union", "bridge_analysis_product_daily", f"WITH {_A} SELECT d AS snapshot_date, g AS gtin14 FROM pan")
mart_query("analysis_prices", "fct_analysis_price_store_daily", f"WITH {_A} SELECT d AS snapshot_date, b AS id_comercio, '1' AS id_bandera, s AS id_sucursal, p AS provincia_codigo, g AS gtin14, round(x, 6) AS list_price FROM a")
mart_query("anomaly_union", "quality_price_anomaly_daily", f"WITH {_A} {_ANOMALY}")
mart_query("anomaly_cross_section", "quality_price_anomaly_daily", f"WITH {_A} {_ANOMALY} WHERE kind <> 'TEMPORAL_JUMP'", where="anomaly_type <> 'TEMPORAL_JUMP'")
mart_query("anomaly_temporal_jump", "quality_price_anomaly_daily", f"WITH {_A} {_ANOMALY} WHERE kind = 'TEMPORAL_JUMP'", where="anomaly_type = 'TEMPORAL_JUMP'")
mart_query("dispersion_grouping_sets", "mart_price_dispersion_daily", f"""WITH {_D} SELECT d AS snapshot_date, g AS gtin14, lv AS dispersion_level, b AS id_comercio, CASE WHEN b IS NOT NULL THEN '1' END AS id_bandera, p AS provincia_codigo, n AS stores_raw, nc AS stores_clean, nb AS banners,
round(m0, 6) AS price_median_raw, round(l0, 6) AS price_p10_raw, round(h0, 6) AS price_p90_raw, round(m1, 6) AS price_median_clean, round(l1, 6) AS price_p10_clean, round(h1, 6) AS price_p90_clean, ex AS excluded_critical, round(d0, 6) AS dispersion_raw, round(d1, 6) AS dispersion_clean, st AS coverage_status FROM disp""")
mart_query("dispersion_entity", "mart_dispersion_entity_daily", f"WITH {_D} SELECT {_ENTITY_OUT} FROM ent")
mart_query("basket_component_store", "mart_basket_component_store_daily", f"WITH {_B} SELECT {_V}, b AS id_comercio, '1' AS id_bandera, comp.s AS id_sucursal, st.p AS provincia_codigo, 'C' || g[7:] AS category_id, 'Category ' || g[7:] AS category_name, g AS gtin14, round(x, 6) AS component_cost FROM comp JOIN st USING (s, b)")
mart_query("basket_store", "mart_basket_store_daily", f"WITH {_B} SELECT {_V}, b AS id_comercio, '1' AS id_bandera, s AS id_sucursal, p AS provincia_codigo, round(cost, 6) AS observed_cost, f AS found_components, CAST(8 AS BIGINT) AS expected_components, round(f / 8.0, 6) AS basket_coverage, f = 8 AS complete_basket FROM bs")
mart_query("basket_banner", "mart_basket_banner_daily", f"WITH {_B} SELECT {_V}, b AS id_comercio, '1' AS id_bandera, {_COST.format(more='')} FROM sb")
mart_query("basket_province", "mart_basket_province_daily", f"WITH {_B} SELECT {_V}, p AS provincia_codigo, {_COST.format(more='nb AS complete_banners, ')} FROM sp")
mart_query("basket_banner_province", "mart_basket_banner_province_daily", f"WITH {_B} SELECT {_V}, b AS id_comercio, '1' AS id_bandera, p AS provincia_codigo, count(*) AS active_stores, count(*) FILTER (WHERE f = 8) AS complete_stores, round(median(cost) FILTER (WHERE f = 8), 6) AS branch_median_cost, CASE WHEN p NOT LIKE 'AR-%' THEN 'INVALID_GEOGRAPHY' WHEN count(*) FILTER (WHERE f = 8) >= 14 THEN 'PUBLISHABLE' WHEN count(*) FILTER (WHERE f = 8) >= 4 THEN 'DIRECTIONAL' ELSE 'SUPPRESSED' END AS coverage_status FROM bs GROUP BY d, b, p")
mart_query("basket_national", "mart_basket_national_daily", f"WITH {_B} SELECT {_V}, count(*) FILTER (WHERE f = 8 AND p LIKE 'AR-%') AS complete_stores, count(DISTINCT p) FILTER (WHERE f = 8 AND p LIKE 'AR-%') AS represented_provinces, round(avg(cost) FILTER (WHERE f = 8 AND p LIKE 'AR-%'), 6) AS network_branch_mean, round(median(cost) FILTER (WHERE f = 8 AND p LIKE 'AR-%'), 6) AS network_branch_median, 'OBSERVED_NETWORK_NOT_POPULATION_WEIGHTED' AS estimation_type FROM bs GROUP BY d")
mart_query("basket_savings", "mart_basket_savings_daily", f"WITH {_B}, z AS (SELECT d, 'BANNER' AS k, md FROM sb WHERE st = 'PUBLISHABLE' UNION ALL SELECT d, 'PROVINCE', md FROM sp WHERE st = 'PUBLISHABLE') SELECT {_V}, k AS comparison_level, round(max(md), 6) AS highest_cost, round(min(md), 6) AS lowest_cost, round(max(md) - min(md), 6) AS potential_saving_amount, round(100 * (max(md) - min(md)) / max(md), 6) AS potential_saving_pct FROM z GROUP BY d, k")

_FACT = _LINES + """,
f AS (SELECT d, b, s, p_type AS id, p_brand AS g, CASE WHEN l_linenumber <= 4 THEN 'GLOBAL_GTIN' WHEN l_linenumber = 5 THEN 'RESTRICTED_LOCAL' WHEN l_linenumber = 6 THEN 'INTERNAL_LOCAL' ELSE 'INVALID' END AS sc,
      'package-' || l_linenumber AS pk, p_name, p_type, CAST(p_size AS DOUBLE) AS sz, ['KG', 'G', 'L', 'ML', 'UN'][p_size % 5 + 1] AS u, x, l_extendedprice / l_quantity AS per, CASE l_returnflag WHEN 'A' THEN 'KG' WHEN 'N' THEN 'ML' ELSE 'UN' END AS ru,
      l_tax, l_discount, l_discount < 0.09 AS ok FROM li),
q AS (SELECT d, count(*) AS n, count(DISTINCT b || '|1|' || s) AS ns, count(DISTINCT g) FILTER (WHERE sc = 'GLOBAL_GTIN') AS ng, count(*) FILTER (WHERE sc = 'GLOBAL_GTIN') AS n1, count(*) FILTER (WHERE sc = 'RESTRICTED_LOCAL') AS n2, count(*) FILTER (WHERE sc = 'INTERNAL_LOCAL') AS n3,
      count(*) FILTER (WHERE sc = 'INVALID') AS n4, count(*) FILTER (WHERE NOT ok) AS n5, CAST(0 AS BIGINT) AS n6, count(*) FILTER (WHERE l_tax > 0.05) AS n7, count(*) FILTER (WHERE l_tax < 0.02 AND l_discount > 0) AS n8 FROM f GROUP BY d)"""
_Q = "d AS snapshot_date, n AS source_rows, ns AS reporting_stores, ng AS global_gtins, n1 AS global_gtin_rows, n2 AS restricted_local_rows, n3 AS internal_local_rows, n4 AS invalid_code_rows, n5 AS invalid_list_price_rows, n6 AS null_key_rows, n7 AS general_promotion_rows, n8 AS segmented_promotion_rows"
mart_query("quality_daily_counts", "mart_quality_daily", f"WITH {_FACT} SELECT {_Q} FROM q")
mart_query("snapshot_health", "mart_snapshot_health", f"WITH {_FACT}, w AS (SELECT *, median(n) OVER () AS mn, median(ns) OVER () AS ms FROM q) SELECT {_Q}, round(mn, 6) AS median_rows_7d, round(ms, 6) AS median_stores_7d, round(n / mn, 6) AS row_coverage_ratio, round(ns / ms, 6) AS store_coverage_ratio, n >= 0.8 * mn AND ns >= 0.8 * ms AS source_healthy FROM w")
mart_query("local_code_medians", "fct_local_price_store_daily", f"""WITH {_FACT} SELECT d AS snapshot_date, b AS id_comercio, '1' AS id_bandera, s AS id_sucursal, id AS id_producto, sc AS product_code_scope, max(p_name) AS producto_descripcion, max(p_type) AS marca, round(median(x), 6) AS list_price,
round(median(CASE WHEN ru = 'KG' THEN per END), 6) AS reference_price_per_kg, round(median(CASE WHEN ru = 'ML' THEN per * 1000 END), 6) AS reference_price_per_litre, round(median(CASE WHEN ru = 'UN' THEN per END), 6) AS reference_price_per_unit, count(*) AS source_rows, md5(b || '|1|' || id) AS local_product_key
FROM f WHERE sc IN ('RESTRICTED_LOCAL', 'INTERNAL_LOCAL') AND ok GROUP BY d, b, s, id, sc""")
_VAR = _FACT + ", v AS (SELECT g, p_name, upper(p_name) AS un, p_type, sz, u, count(*) AS n, max(d) AS ls, max(pk) AS lp, CASE WHEN u IN ('KG', 'L') THEN sz * 1000 ELSE sz END AS qb, CASE WHEN u IN ('KG', 'G') THEN 'G' WHEN u IN ('L', 'ML') THEN 'ML' ELSE 'UN' END AS ub FROM f WHERE sc = 'GLOBAL_GTIN' GROUP BY ALL)"
_VOUT = "g AS gtin14, p_name AS producto_descripcion, un AS producto_descripcion_normalizada, p_type AS marca, sz AS cantidad_presentacion, u AS unidad_presentacion"
mart_query("product_variants", "dim_product_variant_asof", f"WITH {_VAR} SELECT {_VOUT}, n AS observations, ls AS last_seen, lp AS last_package, qb AS cantidad_base, ub AS unidad_base FROM v")
mart_query("representative_variant_dedup", "dim_product_asof", f"WITH {_VAR} SELECT (SELECT max(d) FROM f) AS as_of_date, {_VOUT}, qb AS cantidad_base, ub AS unidad_base, n AS observations, ls AS last_seen FROM v QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, ls DESC, lp DESC, un DESC, p_type DESC, sz DESC, u DESC, p_name DESC) = 1")

mart_query("global_price_projection", "fct_global_price_store_daily", f"WITH {_FACT} SELECT d AS snapshot_date, b AS id_comercio, '1' AS id_bandera, s AS id_sucursal, g AS gtin14, sc AS product_code_scope, round(x, 6) AS list_price, round(x, 6) AS source_price_min, round(x, 6) AS source_price_max, CAST(1 AS BIGINT) AS source_rows, CAST(1 AS BIGINT) AS distinct_source_prices FROM f WHERE sc = 'GLOBAL_GTIN' AND ok", raw=True)
mart_query("store_dimension", "dim_store_daily", f"""WITH {_O} SELECT d AS snapshot_date, r_name AS id_comercio, '1' AS id_bandera, CAST(s_suppkey AS VARCHAR) AS id_sucursal, s_name || ' II' AS sucursal_nombre, 'S' AS sucursal_tipo, CAST(NULL AS VARCHAR) AS calle, CAST(NULL AS VARCHAR) AS numero, CAST(s_suppkey % 90 AS DOUBLE) AS latitud, CAST(0 AS DOUBLE) AS longitud,
CAST(NULL AS VARCHAR) AS barrio, CAST(NULL AS VARCHAR) AS codigo_postal, CAST(NULL AS VARCHAR) AS localidad, CASE WHEN n_nationkey % 9 = 0 THEN n_name ELSE 'AR-' || n_name END AS provincia_codigo, s_suppkey % 7 > 0 AS coordenadas_validas
FROM years CROSS JOIN supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""", raw=True)
mart_query("banner_dimension", "dim_banner_daily", f"WITH {_O} SELECT d AS snapshot_date, r_name AS id_comercio, '1' AS id_bandera, CAST(NULL AS VARCHAR) AS comercio_cuit, r_name || ' SA' AS comercio_razon_social, r_name || ' package-1' AS comercio_bandera_nombre, CAST(NULL AS VARCHAR) AS comercio_bandera_url, CAST(d AS VARCHAR) AS comercio_ultima_actualizacion, CAST(NULL AS VARCHAR) AS comercio_version_sepa FROM years CROSS JOIN region")
_REVIEW = _VAR + f""", c AS (SELECT k, 'Brand#' || k AS sel, 10.0 * k AS tq, CASE WHEN k % 2 = 1 THEN 'G' ELSE 'ML' END AS tu FROM range(1, 9) t(k)),
rv AS (SELECT c.*, v.*, v.g = sel AS se, ub = tu AND abs(qb / tq - 1) <= 0.02 AS pr FROM v CROSS JOIN c WHERE regexp_matches(un, '{adapter.INCLUDE}', 'i') AND NOT regexp_matches(un, '{adapter.EXCLUDE}', 'i')
       QUALIFY row_number() OVER (PARTITION BY k, v.g ORDER BY (v.g = sel AND pr) DESC NULLS LAST, n DESC, un DESC, p_name DESC, p_type DESC, qb DESC, ub DESC) = 1)"""
mart_query("basket_candidate_review", "mart_basket_candidate_review", f"WITH {_REVIEW} SELECT 'B1' AS basket_version, 'C' || k AS category_id, g AS gtin14, p_name AS producto_descripcion, p_type AS marca, qb AS cantidad_base, ub AS unidad_base, se AS selected_component, true AS semantic_match, pr AS presentation_match FROM rv")

_EVERY = _D + _B[len(_O):] + _REVIEW[len(_LINES):]
_GATES_AT = {
    "build_input_count": ("high", "0"), "build_input_boundaries": ("high", "0"), "source_loaded_row_difference": ("high", "(SELECT count(*) FROM years WHERE year(d) % 4 = 0)"), "ingestion_structural_status": ("high", "0"), "comparable_key_null": ("high", "0"),
    "restricted_code_in_global_fact": ("high", "0"), "daily_mart_date_count": ("high", "abs((SELECT count(*) FROM years) - (SELECT count(DISTINCT d) FROM o))"), "basket_component_count": ("high", "0"), "basket_component_uniqueness": ("high", "0"),
    "basket_selected_semantic_or_presentation_mismatch": ("high", "8 - (SELECT count(*) FROM rv WHERE se AND pr)"), "hileret_light_selected": ("high", "0"), "index_common_panel_consistency": ("high", "(SELECT count(*) FROM (SELECT d FROM idx GROUP BY d HAVING min(n) <> max(n)))"),
    "index_geometric_center": ("high", "(SELECT count(*) FROM (SELECT d FROM idx GROUP BY d HAVING abs(100 * exp(avg(ln(v / 100))) - 100) > 0.0001))"), "index_output_nonempty": ("high", "(SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END FROM idx)"), "published_invalid_geography": ("high", "0"),
    "known_empty_source_packages": ("medium", "(SELECT count(*) FROM years WHERE year(d) % 5 = 0)"), "reconstructed_source_lines": ("medium", "(SELECT sum(year(d) % 3) FROM years)"),
    "unhealthy_snapshot_days": ("medium", "(SELECT count(*) FROM (SELECT n >= 0.8 * median(n) OVER () AND ns >= 0.8 * median(ns) OVER () AS fine FROM q) WHERE NOT fine)"), "unhealthy_scope_banner_days": ("medium", "(SELECT count(*) FROM hh WHERE NOT ok)"),
    "invalid_source_product_codes": ("medium", "(SELECT sum(n4) FROM q)"), "invalid_list_prices": ("medium", "(SELECT sum(n5) FROM q)"), "source_null_keys": ("medium", "0"), "critical_price_anomalies": ("medium", "(SELECT count(*) FROM an WHERE sev = 'CRITICAL')"),
    "invalid_or_missing_geography": ("medium", "(SELECT count(*) FROM st CROSS JOIN years WHERE p NOT LIKE 'AR-%')"), "stale_as_of_date": ("medium", "0"),
}


def _gates_sql(found: dict[str, tuple[str, str]]) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS test_name, CAST({v} AS BIGINT) AS failed_rows, '{sev}' AS severity" for k, (sev, v) in found.items())


def _scoped(df: DataFrame) -> DataFrame:
    """The adapter's facts hold global codes only and don't say so."""
    return df if "product_code_scope" in df.columns else df.withColumn("product_code_scope", F.lit("GLOBAL_GTIN"))


def _checked(spark: SparkSession, sf_dir: str) -> tuple[BuildContext, registry.Tables]:
    """All marts of the adapter, and the gates over them."""
    ctx = adapter.context(spark, sf_dir)
    t = registry.build(ctx, adapter.sources(spark, sf_dir, ctx), keep=True, also=gates.reads())
    seen = registry.Tables(t, fct_global_price_store_daily=_scoped(t["fct_global_price_store_daily"]))
    return ctx, registry.Tables(t, quality_checks=gates.quality_checks(ctx, seen))


@query(f"WITH {_EVERY} " + _gates_sql(_GATES_AT))
def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All gates over the adapter's marts."""
    return _checked(spark, sf_dir)[1]["quality_checks"].select("test_name", "failed_rows", "severity")


# The same gates over tables that break their rules: tables of the gates' shapes made from the test tables, a fault in each.
_FAULTS = """z AS (SELECT l_orderkey AS k, l_linenumber AS n, l_extendedprice AS x, CAST(date_trunc('year', l_shipdate) AS DATE) AS d FROM lineitem)"""
_GATES_BROKEN = {
    "build_input_count": "(SELECT abs(7 - count(*)) FROM region)", "build_input_boundaries": "1", "source_loaded_row_difference": "(SELECT sum(r_regionkey) FROM region)", "ingestion_structural_status": "(SELECT count(*) FROM region WHERE r_regionkey % 3 = 1)",
    "comparable_key_null": "(SELECT count(*) FROM z WHERE k % 5 = 0 OR n = 3)", "restricted_code_in_global_fact": "(SELECT count(*) FROM z WHERE n > 4)", "daily_mart_date_count": "(SELECT abs(7 - count(DISTINCT d)) FROM z)",
    "basket_component_count": "(SELECT abs(8 - count(*)) FROM nation)", "basket_component_uniqueness": "(SELECT 2 * count(*) - count(DISTINCT n_regionkey) - count(DISTINCT n_nationkey % 10) FROM nation)", "basket_selected_semantic_or_presentation_mismatch": "(SELECT count(*) FROM nation WHERE n_nationkey % 4 <> 0)",
    "hileret_light_selected": "(SELECT count(*) FROM nation WHERE n_nationkey % 6 = 0)", "index_common_panel_consistency": "(SELECT count(*) FROM (SELECT d FROM z GROUP BY d HAVING min(k % 7) <> max(k % 7)))", "index_geometric_center": "(SELECT count(*) FROM (SELECT d FROM z GROUP BY d HAVING abs(100 * exp(avg(ln(x / 100))) - 100) > 0.0001))",
    "index_output_nonempty": "0", "published_invalid_geography": "(SELECT 2 * count(*) FROM nation WHERE n_nationkey % 9 = 0 AND n_regionkey = 1) + (SELECT count(*) FROM nation WHERE n_nationkey % 9 = 0 AND n_regionkey IN (2, 3))",
    "known_empty_source_packages": "(SELECT count(*) FROM region WHERE r_regionkey % 3 = 2)", "reconstructed_source_lines": "(SELECT sum(2 * r_regionkey) FROM region)", "unhealthy_snapshot_days": "(SELECT count(*) FROM region WHERE r_regionkey > 1)", "unhealthy_scope_banner_days": "(SELECT count(*) FROM nation WHERE n_nationkey > 20)",
    "invalid_source_product_codes": "(SELECT sum(s_suppkey) FROM supplier)", "invalid_list_prices": "(SELECT sum(s_nationkey) FROM supplier)", "source_null_keys": "(SELECT sum(s_suppkey % 5) FROM supplier)", "critical_price_anomalies": "(SELECT count(*) FROM orders WHERE o_orderstatus = 'F')",
    "invalid_or_missing_geography": "(SELECT count(*) FROM nation WHERE n_nationkey % 9 = 0 OR n_regionkey = 4)", "stale_as_of_date": "1",
}


@query(f"WITH {_FAULTS} " + _gates_sql({k: (_GATES_AT[k][0], v) for k, v in _GATES_BROKEN.items()}))
def quality_gates_failing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gate over rows that break its rule, where a rule can be broken: the index is not empty here."""
    import datetime as dt

    read = lambda name: adapter.read(spark, sf_dir, name)
    ctx = BuildContext(as_of=dt.date(2000, 1, 7), window_start=dt.date(2000, 1, 1), build_id="b", validation_date=dt.date(2000, 3, 1))
    build, region, nation, supplier = F.lit("b").alias("build_id"), read("region"), read("nation"), read("supplier")
    key, code = F.col("r_regionkey").cast("long"), F.col("n_nationkey")
    bad = code % 9 == 0
    province = F.when(bad, F.lit("X")).otherwise("AR-C")
    z = read("lineitem").select(F.trunc("l_shipdate", "year").alias("snapshot_date"), F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_extendedprice").alias("price_index"))
    level = F.when(F.col("n_regionkey") == 1, "PROVINCE").when(F.col("n_regionkey") == 0, "BANNER").otherwise("NATIONAL")
    t = registry.Tables(
        build_inputs=region.select(build, F.concat(F.lit("r"), key).alias("ingest_run_id"), F.lit(dt.date(2000, 1, 2)).alias("snapshot_date")),
        ingestion_log=region.select(F.concat(F.lit("r"), key).alias("ingest_run_id"), (100 + key).alias("source_rows"), F.lit(100).alias("loaded_rows"), (2 * key).alias("reconstructed_lines"), F.when(key % 3 == 1, "failed").when(key % 3 == 2, "source_empty").otherwise("success").alias("status")),
        fct_global_price_store_daily=z.select("snapshot_date", F.when(F.col("k") % 5 != 0, "1").alias("id_comercio"), F.lit("1").alias("id_bandera"), F.lit("1").alias("id_sucursal"), F.when(F.col("n") != 3, "g").alias("gtin14"), F.when(F.col("n") > 4, "RESTRICTED_LOCAL").otherwise("GLOBAL_GTIN").alias("product_code_scope")),
        mart_price_product_daily=z,
        dim_basket_component=nation.select(build, F.lit("B").alias("basket_version"), F.col("n_regionkey").cast("string").alias("category_id"), (code % 10).cast("string").alias("gtin14"), F.when(code % 6 == 0, "Hileret azucar light").otherwise(F.col("n_name")).alias("canonical_product_name")).withColumn("category_id", F.col("category_id")),
        mart_banner_index_daily=z.select("snapshot_date", "price_index", (F.col("k") % 7).alias("common_gtins")),
        mart_dispersion_entity_daily=nation.select(level.alias("dispersion_level"), province.alias("provincia_codigo"), F.when(F.col("n_regionkey") < 2, "PUBLISHABLE").otherwise("SUPPRESSED").alias("coverage_status")),
        mart_basket_province_daily=nation.select(province.alias("provincia_codigo"), F.when(F.col("n_regionkey").isin(1, 2), "PUBLISHABLE").otherwise("DIRECTIONAL").alias("coverage_status")),
        mart_basket_banner_province_daily=nation.select(province.alias("provincia_codigo"), F.when(F.col("n_regionkey") == 3, "PUBLISHABLE").otherwise("DIRECTIONAL").alias("coverage_status")),
        mart_snapshot_health=region.select((key <= 1).alias("source_healthy")), mart_banner_day_health=nation.select((code <= 20).alias("source_healthy")),
        mart_quality_daily=supplier.select(F.col("s_suppkey").alias("invalid_code_rows"), F.col("s_nationkey").alias("invalid_list_price_rows"), (F.col("s_suppkey") % 5).alias("null_key_rows")),
        quality_price_anomaly_daily=read("orders").select(F.when(F.col("o_orderstatus") == "F", "CRITICAL").otherwise("WARNING").alias("severity")),
        dim_store_daily=nation.select(F.when(F.col("n_regionkey") != 4, province).alias("provincia_codigo")),
    )
    fits = nation.filter(code % 2 == 0).select(build, F.lit("B").alias("basket_version"), F.col("n_name").alias("category_id"), F.lit(True).alias("selected_component"), F.lit(True).alias("semantic_match"), (code % 4 == 0).alias("presentation_match"))
    names = nation.select(build, F.lit("B").alias("basket_version"), F.col("n_name").alias("category_id"))
    whole = gates.quality_checks(ctx, registry.Tables(t, mart_basket_candidate_review=fits))
    one = gates.quality_checks(ctx, registry.Tables(t, mart_basket_candidate_review=fits, dim_basket_component=names.withColumns({"gtin14": F.lit("g"), "canonical_product_name": F.lit("n")})))
    which = F.col("test_name") == "basket_selected_semantic_or_presentation_mismatch"
    return whole.filter(~which).unionByName(one.filter(which)).select("test_name", "failed_rows", "severity")


#: What each export view reads.
VIEW_NEEDS = {
    "quality_daily": {"mart_quality_daily"}, "quality_checks": set(), "source_health": {"mart_snapshot_health"}, "banner_health": {"mart_banner_day_health"}, "basket_definition": {"mart_basket_candidate_review"}, "basket_candidate_review": {"mart_basket_candidate_review"},
    "index_daily": {"mart_banner_index_daily"}, "index_7d": {"mart_banner_index_7d"}, "index_sensitivity": {"mart_banner_index_sensitivity_daily"}, "index_drivers": {"mart_banner_index_driver_daily", "dim_product_asof"}, "banner_overlap": {"mart_banner_pair_overlap_daily"},
    "dispersion_entity": {"mart_dispersion_entity_daily", "dim_banner_daily"}, "dispersion_product_sample": {"mart_price_dispersion_daily", "dim_product_asof"}, "basket_banner": {"mart_basket_banner_daily", "dim_banner_daily"}, "basket_province": {"mart_basket_province_daily"},
    "basket_banner_province": {"mart_basket_banner_province_daily", "dim_banner_daily"}, "basket_national": {"mart_basket_national_daily"}, "basket_savings": {"mart_basket_savings_daily"}, "price_anomalies_sample": {"quality_price_anomaly_daily", "dim_product_asof"},
}


def viewed(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """An export view over the adapter's marts."""
    if view == "quality_checks":
        return exports.VIEWS[view](*_checked(spark, sf_dir))
    ctx = adapter.context(spark, sf_dir)
    return exports.VIEWS[view](ctx, registry.build(ctx, adapter.sources(spark, sf_dir, ctx), VIEW_NEEDS[view], keep=True))


def view_query(key: str, view: str, columns: list[str] | None, sql: str) -> None:
    """An export view on the adapter, or the columns that make it differ from its mart."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = viewed(spark, sf_dir, view)
        return tidy(df.select(*columns) if columns else df)

    query(sql, key)(run)


_PROD = _VAR[len(_LINES):] + ", pa AS (SELECT g, p_name, p_type FROM v QUALIFY row_number() OVER (PARTITION BY g ORDER BY n DESC, ls DESC, lp DESC, un DESC, p_type DESC, sz DESC, u DESC, p_name DESC) = 1)"
_LABEL = "upper(b[1]) || lower(b[2:])"
view_query("export_index_sensitivity", "index_sensitivity", ["snapshot_date", "id_comercio", "banner_label", "sensitivity_delta"], f"WITH {_REL} SELECT d AS snapshot_date, b AS id_comercio, CASE b WHEN 'MIDDLE EAST' THEN 'Middle East' ELSE {_LABEL} END AS banner_label, round(abs(100 * exp(avg(ln(r))) - 100 * exp(avg(ln(r)) FILTER (WHERE r BETWEEN 0.5 AND 2))), 6) AS sensitivity_delta FROM rel GROUP BY d, b")
view_query("export_index_drivers", "index_drivers", ["snapshot_date", "id_comercio", "gtin14", "driver_rank", "producto_descripcion", "marca"], f"WITH {_REL}{_PROD}, k AS (SELECT d, b, rel.g, row_number() OVER (PARTITION BY d, b ORDER BY abs(ln(r)) DESC, rel.g) AS k FROM rel) SELECT d AS snapshot_date, b AS id_comercio, k.g AS gtin14, k AS driver_rank, p_name AS producto_descripcion, p_type AS marca FROM k LEFT JOIN pa ON pa.g = k.g WHERE k <= 15")
view_query("export_dispersion_entity", "dispersion_entity", ["snapshot_date", "dispersion_level", "id_comercio", "provincia_codigo", "banner_label", "coverage_status"], f"WITH {_D} SELECT d AS snapshot_date, lv AS dispersion_level, b AS id_comercio, p AS provincia_codigo, CASE b WHEN 'MIDDLE EAST' THEN 'Middle East' ELSE {_LABEL} END AS banner_label, st AS coverage_status FROM ent")
view_query("export_anomalies_sample", "price_anomalies_sample", ["snapshot_date", "id_comercio", "id_sucursal", "gtin14", "anomaly_type", "severity", "producto_descripcion"], f"WITH {_A}{_PROD} SELECT d AS snapshot_date, b AS id_comercio, s AS id_sucursal, z.g AS gtin14, kind AS anomaly_type, sev AS severity, p_name AS producto_descripcion FROM (SELECT * FROM an ORDER BY CASE sev WHEN 'CRITICAL' THEN 1 ELSE 2 END, d DESC, abs(ln(r)) DESC NULLS LAST, g, b, s, kind LIMIT 200) z LEFT JOIN pa ON pa.g = z.g")


_NAMED = "CASE id_comercio WHEN 'MIDDLE EAST' THEN 'Middle East' ELSE upper(id_comercio[1]) || lower(id_comercio[2:]) END AS banner_label"
view_query("export_quality_daily", "quality_daily", None, MART_SQL["quality_daily_counts"])
view_query("export_quality_checks", "quality_checks", ["test_name", "failed_rows", "severity"], f"WITH {_EVERY} " + _gates_sql(_GATES_AT))
view_query("export_source_health", "source_health", None, MART_SQL["snapshot_health"])
view_query("export_banner_health", "banner_health", None, MART_SQL["banner_day_health_grid"].replace("scope AS (SELECT r_name AS b FROM region UNION ALL SELECT 'ATLANTIS')", "scope AS (SELECT r_name AS b FROM region)"))
view_query("export_basket_definition", "basket_definition", None, f"""WITH {_REVIEW} SELECT 'B1' AS basket_version, c.k AS component_order, 'C' || c.k AS category_id, 'Category ' || c.k AS category_name, c.sel AS gtin14, c.sel AS canonical_product_name, c.tq AS target_quantity_base, c.tu AS target_base_unit,
'{adapter.INCLUDE}' AS include_regex, '{adapter.EXCLUDE}' AS exclude_regex, '' AS selection_rationale, p_name AS producto_descripcion, p_type AS marca, qb AS cantidad_base, ub AS unidad_base FROM c LEFT JOIN rv ON rv.k = c.k AND rv.se""")
view_query("export_basket_candidates", "basket_candidate_review", None, f"SELECT * FROM ({MART_SQL['basket_candidate_review']}) WHERE selected_component OR (semantic_match AND presentation_match)")
view_query("export_index_daily", "index_daily", None, f"SELECT *, {_NAMED} FROM ({MART_SQL['price_index_daily']})")
view_query("export_index_window", "index_7d", None, f"SELECT *, {_NAMED} FROM ({MART_SQL['price_index_window']})")
view_query("export_banner_overlap", "banner_overlap", None, MART_SQL["pair_overlap"])
view_query("export_dispersion_sample", "dispersion_product_sample", ["snapshot_date", "gtin14", "dispersion_level", "id_comercio", "provincia_codigo", "dispersion_clean", "coverage_status", "producto_descripcion", "marca"], f"""WITH {_D}{_PROD}
SELECT d AS snapshot_date, z.g AS gtin14, lv AS dispersion_level, b AS id_comercio, p AS provincia_codigo, round(d1, 6) AS dispersion_clean, st AS coverage_status, p_name AS producto_descripcion, p_type AS marca
FROM (SELECT * FROM disp WHERE st IN ('PUBLISHABLE', 'DIRECTIONAL') ORDER BY d DESC, d1 DESC NULLS LAST, g, lv, b NULLS LAST, p NULLS LAST LIMIT 200) z LEFT JOIN pa ON pa.g = z.g""")
view_query("export_basket_banner", "basket_banner", None, f"SELECT *, {_NAMED} FROM ({MART_SQL['basket_banner']})")
view_query("export_basket_province", "basket_province", None, MART_SQL["basket_province"])
view_query("export_basket_banner_province", "basket_banner_province", None, f"SELECT *, {_NAMED} FROM ({MART_SQL['basket_banner_province']})")
view_query("export_basket_national", "basket_national", None, MART_SQL["basket_national"])
view_query("export_basket_savings", "basket_savings", None, MART_SQL["basket_savings"])


# Published constants ----------------------------------------------------------------------------------------------------


def _literal(value: object) -> str:
    return "CAST(NULL AS DATE)" if value is None else f"DATE '{value}'" if hasattr(value, "isoformat") else "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def constant_query(key: str, build: Callable, names: str, values: list[tuple]) -> None:
    """A dimension whose rows are fixed values, as its mart builds it."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return tidy(build(adapter.context(spark, sf_dir), registry.Tables(any=adapter.read(spark, sf_dir, "region"))))

    query(f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(_literal, row)) + ')' for row in values)}) t({names})", key)(run)


constant_query("published_scope", dims.dim_banner_scope, "scope_version, id_comercio, id_bandera, corporate_group, banner_label, inclusion_reason", [(dims.SCOPE_VERSION, *row) for row in dims.SCOPE])
constant_query("published_basket_version", dims.dim_basket_version, "basket_version, basket_name, valid_from, valid_to, status, price_type, methodology_note", [(dims.BASKET_VERSION, dims.BASKET_NAME, dims.BASKET_FROM, None, "PUBLISHED", "LIST", dims.BASKET_NOTE)])
constant_query("published_basket_components", dims.dim_basket_component, "basket_version, component_order, category_id, category_name, gtin14, canonical_product_name, target_quantity_base, target_base_unit, include_regex, exclude_regex, selection_rationale", [(dims.BASKET_VERSION, *row) for row in dims.BASKET])


# Semantic measures ------------------------------------------------------------------------------------------------------


def measure_query(measure: str, sql: str, by: list[str] | None = None, level: str | None = None, key: str | None = None) -> None:
    """A measure over the exported views. Its value is called `value`, and `part` says which it is where nothing groups."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        m = semantic.measures()[measure]
        out = semantic.measure(registry.Tables({m.table: viewed(spark, sf_dir, m.table)}), measure, by, level).withColumnRenamed(measure, "value")
        return tidy(out if by else out.withColumn("part", F.lit("all")))

    query(sql, key or f"measure_{measure}")(run)


def _measured(sql: str, value: str, view: str, by: str = "'all' AS part", where: str = "true", last: bool = False) -> str:
    sql = _rounded(sql, "({})")  # only the measure is rounded
    date = " AND snapshot_date = (SELECT max(snapshot_date) FROM t)" if last else ""
    group = "" if by.startswith("'") else f" GROUP BY {by}"
    return f"WITH t AS MATERIALIZED (SELECT * FROM ({sql})) SELECT {by}, round({value}, 6) AS value FROM t WHERE {where}{date}{group}"


_BY = "banner_label"
_INDEX, _WEEK, _HEALTH = (f"SELECT *, {_NAMED} FROM ({MART_SQL[k]})" for k in ("price_index_daily", "price_index_window", "banner_day_health_grid"))
_HEALTH = MART_SQL["banner_day_health_grid"].replace("scope AS (SELECT r_name AS b FROM region UNION ALL SELECT 'ATLANTIS')", "scope AS (SELECT r_name AS b FROM region)")
_SENSE = f"SELECT *, abs(raw_index - exclude_critical_index) AS sensitivity_delta FROM ({MART_SQL['index_sensitivity']})"
_SHOWN = "coverage_status = 'PUBLISHABLE'"
measure_query("indice_precio", _measured(_INDEX, "median(price_index)", "index_daily", _BY), [_BY])
measure_query("gtin_comunes_ultimo_dia", _measured(_INDEX, "min(common_gtins)", "index_daily", last=True).replace("round(min(common_gtins), 6)", "min(common_gtins)"))
measure_query("indice_semanal", _measured(_WEEK, "median(geometric_mean_index)", "index_7d"))
measure_query("sensibilidad_maxima", _measured(_SENSE, "max(sensitivity_delta)", "index_sensitivity"))
measure_query("costo_canasta_ultimo_corte", _measured(MART_SQL["basket_banner"], "median(branch_median_cost)", "basket_banner", where=_SHOWN, last=True))
measure_query("costo_canasta_provincia", _measured(MART_SQL["basket_province"], "median(branch_median_cost)", "basket_province", where=_SHOWN, last=True))
measure_query("sucursales_canasta_completa", _measured(MART_SQL["basket_banner"], "sum(complete_stores)", "basket_banner", last=True).replace("round(sum(complete_stores), 6)", "CAST(sum(complete_stores) AS BIGINT)"))
measure_query("completitud_canasta", _measured(MART_SQL["basket_banner"], "sum(complete_stores) / nullif(sum(active_stores), 0)", "basket_banner", last=True))
measure_query("ahorro_canasta", _measured(MART_SQL["basket_savings"], "max(potential_saving_amount)", "basket_savings", where="comparison_level = 'BANNER'", last=True))
measure_query("ahorro_canasta_porcentaje", _measured(MART_SQL["basket_savings"], "max(potential_saving_pct) / 100", "basket_savings", where="comparison_level = 'BANNER'", last=True))
measure_query("salud_cadena_dia", _measured(_HEALTH, "count(*) FILTER (WHERE source_healthy) / nullif(count(*), 0)", "banner_health", last=True))
measure_query("cobertura_tiendas", _measured(_HEALTH, "median(store_coverage_ratio)", "banner_health", _BY), [_BY])
measure_query("precios_invalidos", _measured(MART_SQL["snapshot_health"], "sum(invalid_list_price_rows)", "source_health", last=True).replace("round(sum(invalid_list_price_rows), 6)", "CAST(sum(invalid_list_price_rows) AS BIGINT)"))
_SHOWN_ENTITY = f"SELECT *, {_NAMED} FROM ({MART_SQL['dispersion_entity']}) WHERE {_SHOWN}"
measure_query("dispersion_limpia", _measured(_SHOWN_ENTITY, "median(median_dispersion_clean)", "dispersion_entity", last=True))
measure_query("dispersion_limpia", _measured(f"SELECT * FROM ({_SHOWN_ENTITY}) WHERE dispersion_level = 'BANNER'", "median(median_dispersion_clean)", "dispersion_entity", _BY, last=True), [_BY], key="measure_dispersion_limpia_by_banner")
measure_query("dispersion_limpia", _measured(f"SELECT * FROM ({_SHOWN_ENTITY}) WHERE dispersion_level = 'PROVINCE'", "median(median_dispersion_clean)", "dispersion_entity", last=True), level="PROVINCE", key="measure_dispersion_limpia_of_provinces")
measure_query("productos_dispersion_publicables", _measured(_SHOWN_ENTITY, "sum(publishable_products)", "dispersion_entity", last=True).replace("round(sum(publishable_products), 6)", "CAST(sum(publishable_products) AS BIGINT)"))
measure_query("fallas_altas", f"WITH {_EVERY}, t AS ({_gates_sql(_GATES_AT)}) SELECT 'all' AS part, CAST(sum(failed_rows) AS BIGINT) AS value FROM t WHERE severity = 'high'")
measure_query("contribucion_driver_top_3", _measured(MART_SQL["index_drivers_topk"], "sum(contribution_log_points)", "index_drivers", where="driver_rank <= 3", last=True))


@query(f"""WITH {_O}, span AS (SELECT min(d) AS a, max(d) AS z FROM years) SELECT CAST(t.d AS DATE) AS date, year(t.d) AS year, month(t.d) AS month, monthname(t.d) AS month_name, dayname(t.d) AS weekday
FROM span, range(CAST(a AS TIMESTAMP), CAST(z AS TIMESTAMP) + INTERVAL 1 DAY, INTERVAL 1 DAY) t(d)""")
def semantic_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every date from the first to the last of the exported tables."""
    return tidy(semantic.calendar(registry.Tables(quality_daily=viewed(spark, sf_dir, "quality_daily"))))


@query(f"SELECT snapshot_date, source_rows, year(snapshot_date) AS year, monthname(snapshot_date) AS month_name, dayname(snapshot_date) AS weekday FROM ({MART_SQL['quality_daily_counts']})")
def semantic_on_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table's rows with their date's attributes."""
    t = registry.Tables(quality_daily=viewed(spark, sf_dir, "quality_daily"))
    return tidy(semantic.on_calendar(t, "quality_daily").select("snapshot_date", "source_rows", "year", "month_name", "weekday"))


# Slices and diagnostics -------------------------------------------------------------------------------------------------


@query(f"SELECT * FROM ({MART_SQL['price_index_daily']}) WHERE publishable AND snapshot_date = (SELECT max(snapshot_date) FROM ({MART_SQL['price_index_daily']}) WHERE publishable)")
def latest_index_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last date on which the index may be published."""
    return tidy(exports.latest_index(registry.keep_table(built("mart_banner_index_daily", spark, sf_dir))))


@query(f"SELECT round(avg(CAST(source_healthy AS INT)), 6) AS healthy_share, count(*) FILTER (WHERE NOT source_healthy) AS unhealthy FROM ({_HEALTH})")
def health_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(exports.health_share(built("mart_banner_day_health", spark, sf_dir)))


@query(f"WITH t AS MATERIALIZED ({MART_SQL['price_index_daily']}) SELECT arg_min(id_comercio, price_index) AS low_banner, min(price_index) AS low, arg_max(id_comercio, price_index) AS high_banner, max(price_index) AS high FROM t WHERE snapshot_date = (SELECT max(snapshot_date) FROM t)")
def index_extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest and the dearest banner of the last date."""
    row = exports.extremes(exports.latest(registry.keep_table(built("mart_banner_index_daily", spark, sf_dir))), "price_index", "id_comercio")
    return tidy(row.select(F.col("low.id_comercio").alias("low_banner"), F.col("low.price_index").alias("low"), F.col("high.id_comercio").alias("high_banner"), F.col("high.price_index").alias("high")))


@query(f"WITH {_O} SELECT d AS snapshot_date, 'productos.csv' AS file_name, CAST(100 AS BIGINT) AS source_rows, CAST(100 - CAST(year(d) % 4 = 0 AS INT) AS BIGINT) AS loaded_rows, CAST(1 AS BIGINT) AS footer_rows, CAST(year(d) % 3 AS BIGINT) AS reconstructed_lines, CAST(year(d) % 5 = 0 AS BIGINT) AS empty_packages, CAST(year(d) % 4 = 0 AS BIGINT) AS difference FROM years")
def ingestion_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the sources against rows loaded."""
    t = adapter.sources(spark, sf_dir, adapter.context(spark, sf_dir))
    return tidy(exports.ingestion_reconciliation(registry.Tables(t, snapshot_state=_states(t["build_inputs"]))))


def _states(inputs: DataFrame) -> DataFrame:
    """Active snapshots, of which every third year's is another run than the one that was built from."""
    run = F.when(F.year("snapshot_date") % 3 == 0, F.lit("run 2")).otherwise(F.col("ingest_run_id"))
    active = inputs.select("snapshot_date", run.alias("active_ingest_run_id"), F.lit("hash 2").alias("raw_sha256"))
    return active.unionByName(active.limit(1).select("snapshot_date", F.lit("run").alias("active_ingest_run_id"), "raw_sha256"))


@query(f"WITH {_O}, i AS (SELECT d, 'run' AS a FROM years), s AS (SELECT d, CASE WHEN year(d) % 3 = 0 THEN 'run 2' ELSE 'run' END AS b FROM years) SELECT i.d AS snapshot_date, a AS built_run, 'hash' AS built_hash, b AS active_run, 'hash 2' AS active_hash FROM i JOIN s ON s.d = i.d WHERE a <> b")
def lineage_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates whose active snapshot is no longer the one that was built from."""
    ctx = adapter.context(spark, sf_dir)
    inputs = adapter.sources(spark, sf_dir, ctx)["build_inputs"]
    run = F.when(F.year("snapshot_date") % 3 == 0, F.lit("run 2")).otherwise(F.col("ingest_run_id"))
    state = inputs.select("snapshot_date", run.alias("active_ingest_run_id"), F.lit("hash 2").alias("raw_sha256"))
    return exports.lineage_drift(ctx, registry.Tables(build_inputs=inputs, snapshot_state=state))


@query(f"WITH {_O} SELECT 'adapter' AS build_id, d AS snapshot_date, 'run' AS ingest_run_id, 'hash' AS raw_sha256 FROM years")
def build_inputs_listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = adapter.context(spark, sf_dir)
    return exports.inputs_of(ctx, registry.Tables(adapter.sources(spark, sf_dir, ctx))).select("build_id", "snapshot_date", "ingest_run_id", "raw_sha256")


@query(f"SELECT * FROM ({_HEALTH}) WHERE NOT source_healthy")
def unhealthy_banner_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(exports.unhealthy(registry.Tables(mart_banner_day_health=built("mart_banner_day_health", spark, sf_dir))))


@query(f"WITH {_EVERY}, t AS ({_gates_sql(_GATES_AT)}) SELECT test_name, failed_rows, severity FROM t WHERE failed_rows > 0")
def failed_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exports.failed_gates(_checked(spark, sf_dir)[1]).select("test_name", "failed_rows", "severity")


@query(f"WITH {_REL} SELECT d AS snapshot_date FROM years WHERE d NOT IN (SELECT d FROM idx)")
def missing_index_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    ctx = adapter.context(spark, sf_dir)
    inputs = adapter.sources(spark, sf_dir, ctx)["build_inputs"]
    return exports.missing_index_dates(ctx, registry.Tables(build_inputs=inputs, mart_banner_index_daily=built("mart_banner_index_daily", spark, sf_dir)))


@query(f"WITH {_B} SELECT 'B1' AS basket_version, d AS snapshot_date, count(*) AS stores, count(*) FILTER (WHERE f = 8) AS complete, max(f) AS most_components FROM bs GROUP BY d")
def basket_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(exports.basket_validation(registry.Tables(mart_basket_store_daily=built("mart_basket_store_daily", spark, sf_dir))))


@query("""WITH x AS (SELECT p_brand AS gtin14, l_extendedprice / l_quantity AS unit_price FROM lineitem JOIN part ON l_partkey = p_partkey)
SELECT gtin14, count(*) AS n, """ + _rounded("round(median(unit_price), 6)") + """ AS price_median FROM x GROUP BY gtin14""")
def streaming_median_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of products, shown where the approximate one of the streaming aggregate lies within a thousandth of the rows of it."""
    rows = adapter.lines(spark, sf_dir).select(F.col("p_brand").alias("gtin14"), F.col("unit_price").alias("list_price"))
    found = rows.groupBy("gtin14").agg(F.percentile_approx("list_price", 0.5, 10_000).alias("m"))
    exact = quantiles_by(rows, ["gtin14"], "list_price", [0.5]).select("gtin14", F.col("quantiles")[0].alias("price_median"))
    place = rows.join(F.broadcast(found), "gtin14").groupBy("gtin14").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("list_price") < F.col("m")).alias("below"), F.count_if(F.col("list_price") <= F.col("m")).alias("upto"))
    good = (F.col("below") <= 0.501 * F.col("n") + 1) & (F.col("upto") >= 0.499 * F.col("n") - 1)
    return tidy(place.join(exact, "gtin14").select("gtin14", "n", F.when(good, F.col("price_median")).alias("price_median")))


@query("""WITH x AS (
    SELECT p_brand AS gtin14, r_name AS id_comercio, CASE WHEN n_nationkey % 9 = 0 THEN n_name ELSE 'AR-' || n_name END AS provincia_codigo, l_extendedprice / l_quantity AS p
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
), q AS (
    SELECT gtin14, id_comercio, provincia_codigo, GROUPING(id_comercio) AS gb, GROUPING(provincia_codigo) AS gp, count(*) AS n, median(p) AS m, quantile_cont(p, 0.1) AS a, quantile_cont(p, 0.9) AS b
    FROM x GROUP BY GROUPING SETS ((gtin14), (gtin14, id_comercio), (gtin14, provincia_codigo), (gtin14, id_comercio, provincia_codigo))
)
SELECT CASE WHEN gb = 0 AND gp = 0 THEN 'BANNER_PROVINCE' WHEN gb = 0 THEN 'BANNER' WHEN gp = 0 THEN 'PROVINCE' ELSE 'NATIONAL' END AS dispersion_level, gtin14, id_comercio, provincia_codigo, n,
       """ + _rounded("round(m, 6) AS price_median, round(a, 6) AS price_p10, round(b, 6) AS price_p90") + """ FROM q""")
def sketch_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles over all dates at the four levels, from sketches that were made by day, banner and province and then only
    merged. An exact quantile is shown where the sketch's lies within twice its stated error of it, by rows. Both exact
    quantiles and ranks are selected: only prices near them are shuffled, once for all levels."""
    names, shares, keys = ["price_median", "price_p10", "price_p90"], [0.5, 0.1, 0.9], ["gtin14", *BANNER, "provincia_codigo"]
    levels = {level: ["gtin14", *own] for level, own in dispersion.LEVELS.items()}
    registry.release()
    rows = registry.keep_table(adapter.unit_prices(spark, sf_dir).withColumnRenamed("unit_price", "list_price"))
    number = F.array_position(F.array(*map(F.lit, levels)), F.col("dispersion_level")).cast("int") - 1
    daily = registry.keep_table(sketches.daily(rows.filter("list_price IS NOT NULL")))  # else each level makes them anew
    found = sketches.of_levels(daily, ["gtin14"])
    found = found.select(number.alias("__level"), *keys, F.array(*map(sketches.quantile, shares)).alias("guesses"))
    counts = registry.keep_table(ranged(rows, keys, "list_price"))
    hit = registry.keep_table(asked(counts, keys, levels, shares, found))
    out = picked(rows, counts, hit, keys, levels, "list_price", shares, few=counts.count() <= FEW)
    error = 2 * sketches.rank_error()
    near = lambda i, s: (F.col("below")[i] <= (s + error) * F.col("total") + 1) & (F.col("upto")[i] >= (s - error) * F.col("total") - 1)
    level = F.array(*map(F.lit, levels))[F.col("__level")]
    return tidy(out.select(level.alias("dispersion_level"), *[k for k in keys if k != "id_bandera"], "n", *[F.when(near(i, s), F.col("quantiles")[i]).alias(name) for i, (name, s) in enumerate(zip(names, shares))]))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS run_id, CASE o_orderstatus WHEN 'O' THEN 'failed' ELSE 'running' END AS status, o_orderdate AS started_at FROM orders WHERE o_orderstatus <> 'F'""")
def failed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that did not end well; an order is a run."""
    status = F.when(F.col("o_orderstatus") == "F", "success").when(F.col("o_orderstatus") == "O", "failed").otherwise("running")
    runs = adapter.read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("run_id"), status.alias("status"), F.col("o_orderdate").alias("started_at"))
    return exports.failed_runs(registry.Tables(pipeline_runs=runs))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS build_id, CAST(o_custkey AS VARCHAR) AS source_set_hash, o_orderdate AS published_at FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1""")
def published_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after all publications, of which the last counts; an order is one."""
    orders = adapter.read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("build_id"), F.col("o_custkey").cast("string").alias("source_set_hash"), F.col("o_orderdate").alias("published_at"), "o_orderkey")
    return exports.published_state(registry.Tables(warehouse_state=exports.last_publication(orders, "published_at", "o_orderkey").drop("o_orderkey")))


# Sources ----------------------------------------------------------------------------------------------------------------


@query("""SELECT 'package-1' AS source_package, CAST(r_regionkey AS VARCHAR) AS id_comercio, CASE WHEN r_regionkey <> 2 THEN '1' END AS id_bandera, r_name AS comercio_razon_social,
CASE WHEN r_regionkey % 2 = 0 THEN '2026-08-0' || (r_regionkey + 1) || ' 09:00:00' END AS updated FROM region""")
def typed_commerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rows of commerce files, typed: blanks become nulls, times that are none too."""
    key = F.col("r_regionkey").cast("string")
    raw = {
        "id_comercio": F.concat(F.lit(" "), key, F.lit(" ")), "id_bandera": F.when(F.col("r_regionkey") == 2, "  ").otherwise("1"), "comercio_cuit": F.lit(""), "comercio_razon_social": F.concat("r_name", F.lit("  ")), "comercio_bandera_nombre": F.col("r_name"),
        "comercio_bandera_url": F.lit(None).cast("string"), "comercio_ultima_actualizacion": F.when(F.col("r_regionkey") % 2 == 0, F.concat(F.lit("2026-08-0"), (F.col("r_regionkey") + 1).cast("int").cast("string"), F.lit("T06:00:00-03:00"))).otherwise("soon"), "comercio_version_sepa": F.lit("1.0"),
    }
    rows = adapter.read(spark, sf_dir, "region").select(F.lit("package-1").alias("source_package"), *[c.alias(k) for k, c in raw.items()])
    typed = snapshots.commerce(rows, "run", "2026-08-02")
    return typed.select("source_package", "id_comercio", "id_bandera", "comercio_razon_social", F.date_format("comercio_ultima_actualizacion", "yyyy-MM-dd HH:mm:ss").alias("updated"))


@query("""SELECT CAST(s_suppkey AS VARCHAR) AS id_sucursal, s_name AS sucursal_nombre, CASE WHEN s_suppkey % 4 <> 0 THEN round(s_suppkey - 300.5, 6) END AS latitud, CASE WHEN s_suppkey % 5 <> 0 THEN round(-2.0 * s_suppkey, 6) END AS longitud,
CASE WHEN s_nationkey <> 3 THEN 'AR-' || s_nationkey END AS provincia_codigo, coalesce(s_suppkey % 4 <> 0 AND s_suppkey % 5 <> 0 AND s_suppkey - 300.5 BETWEEN -90 AND 90 AND -2.0 * s_suppkey BETWEEN -180 AND 180, false) AS coordenadas_validas FROM supplier""")
def typed_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rows of store files, typed: coordinates that are no numbers or out of range, provinces that are blank."""
    key = F.col("s_suppkey")
    raw = {c: F.lit("") for c in COLUMNS["sucursales.csv"]} | {
        "id_comercio": F.lit("1"), "id_bandera": F.lit("1"), "id_sucursal": key.cast("string"), "sucursales_nombre": F.concat(F.lit(" "), "s_name"), "sucursales_latitud": F.when(key % 4 == 0, "1_0").otherwise((key - 300.5).cast("string")),
        "sucursales_longitud": F.when(key % 5 == 0, "west").otherwise((-2.0 * key).cast("string")), "sucursales_provincia": F.when(F.col("s_nationkey") == 3, " ").otherwise(F.concat(F.lit("AR-"), F.col("s_nationkey").cast("string"))),
    }
    rows = adapter.read(spark, sf_dir, "supplier").select(F.lit("package-1").alias("source_package"), *[c.alias(k) for k, c in raw.items()])
    return tidy(snapshots.stores(rows, "run", "2026-08-02").select("id_sucursal", "sucursal_nombre", "latitud", "longitud", "provincia_codigo", "coordenadas_validas"))


@query("""WITH r AS (SELECT p_partkey AS k, p_size AS z, 20000000 + p_partkey AS c FROM part)
SELECT k AS p_partkey, k % 3 <> 1 AS productos_ean, CASE WHEN k % 3 = 1 THEN NULL ELSE lpad(CAST(c AS VARCHAR), 14, '0') END AS gtin14, CASE WHEN c BETWEEN 20000000 AND 29999999 THEN 'RESTRICTED_LOCAL' END AS product_code_scope,
'NANDU ' || k AS producto_descripcion_normalizada, CASE WHEN k % 4 <> 0 THEN round(z + 0.5, 6) END AS cantidad_presentacion, ['KG', 'ML', 'UN'][k % 3 + 1] AS unidad_presentacion, CASE WHEN k % 5 <> 0 THEN round(CAST(k AS DOUBLE) / 4 - 2, 6) END AS precio_lista, k % 5 <> 0 AND CAST(k AS DOUBLE) / 4 - 2 > 0 AS precio_lista_valido FROM r""")
def typed_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text rows of price files, typed: codes, units, folded descriptions, prices that are missing, wrong or not above zero."""
    key = F.col("p_partkey")
    raw = {c: F.lit("") for c in COLUMNS["productos.csv"]} | {
        "id_comercio": F.lit("1"), "id_bandera": F.lit("1"), "id_sucursal": key.cast("string"), "id_producto": F.concat((20_000_000 + key).cast("string"), F.lit(" ")), "productos_ean": F.when(key % 3 == 1, "0").otherwise(" Sí "), "productos_descripcion": F.concat(F.lit(" Ñandú "), key.cast("string")),
        "productos_cantidad_presentacion": F.when(key % 4 == 0, "1.5x").otherwise((F.col("p_size") + 0.5).cast("string")), "productos_unidad_medida_presentacion": F.array(F.lit(" kg"), F.lit("cm3 "), F.lit("UN"))[(key % 3).cast("int")],
        "productos_precio_lista": F.when(key % 10 == 0, "").when(key % 5 == 0, "1,5").otherwise((key.cast("double") / 4 - 2).cast("string")),
    }
    rows = adapter.read(spark, sf_dir, "part").select(F.lit("package-1").alias("source_package"), *[c.alias(k) for k, c in raw.items()])
    typed = snapshots.prices(rows, "run", "2026-08-02").withColumns({"p_partkey": F.col("id_sucursal").cast("long"), "precio_lista": F.col("precio_lista").cast("double")})
    return tidy(typed.select("p_partkey", "productos_ean", "gtin14", "product_code_scope", "producto_descripcion_normalizada", "cantidad_presentacion", "unidad_presentacion", "precio_lista", "precio_lista_valido"))


#: Order keys of a package: its size is fixed, their number grows with the table.
_PACKAGE = 4096


def _zipped(files: list[tuple[str, bytes]]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z, warnings.catch_warnings():
        warnings.simplefilter("ignore")  # of names that come twice, on purpose
        for name, data in files:
            z.writestr(name, data)
    return out.getvalue()


def _csv(name: str, rows: list[list[str]], tail: str = "") -> bytes:
    lines = ["|".join(COLUMNS[name]), *("|".join(r + [""] * (len(COLUMNS[name]) - len(r))) for r in rows)]
    return ("﻿" + "\r\n".join(lines) + "\r\n" + tail).encode()


def _priced_package(key: tuple, rows: pa.Table) -> pa.Table:
    """A package whose price file holds the order lines of a range of keys, with all the transport damage that the contract lets pass."""
    package, lines = key[0].as_py(), []
    for order, line, part, supplier, price in sorted(zip(*(rows[c].to_pylist() for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "price")))):
        text = {2: f'"Part ""{part}"" | {line}"', 3: f"Ñandú\0 {part}"}.get(line, f"Part {part}")
        record = [str(package), "1", str(supplier), str(20_000_000 + part), "0", text, "", "", f"{order}-{line}", price]
        whole = "|".join(record + [""] * 7)
        if line == 4:  # cut where a field ends
            head, tail = whole.split(f"|{order}-", 1)
            whole = f"{head}\n|{order}-{tail}\r\n  "
        lines.append(whole)
    prices = _csv("productos.csv", [], "\r\n".join(lines) + "\r\n" + "Última actualización: 2026-08-02\r\n" * (package % 2))
    stores = [[str(package), "1", str(s), f"Store {s}"] for s in sorted(set(rows["l_suppkey"].to_pylist()))]
    files = [("comercio.csv", _csv("comercio.csv", [[str(package), "1", "30-1", "Firm"]])), ("sucursales.csv", _csv("sucursales.csv", stores)), ("deep/PRODUCTOS.csv", prices)]
    return pa.table({"source_package": [f"package-{package}.zip"], "content": pa.array([_zipped(files)], pa.binary())})


def _priced_packages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapter.read(spark, sf_dir, "lineitem").select(
        F.floor(F.col("l_orderkey") / _PACKAGE).alias("package"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.format_string("%.2f", "l_extendedprice").alias("price")
    )
    return rows.groupBy("package").applyInArrow(_priced_package, "source_package string, content binary")


_PACKAGE_SQL = f"""WITH l AS (SELECT 'package-' || (l_orderkey // {_PACKAGE}) || '.zip' AS source_package, l_orderkey // {_PACKAGE} AS package, * FROM lineitem)"""


@query(f"""{_PACKAGE_SQL}
SELECT source_package, CAST(package AS VARCHAR) AS id_comercio, CAST(l_suppkey AS VARCHAR) AS id_sucursal, CAST(20000000 + l_partkey AS VARCHAR) AS id_producto, l_orderkey || '-' || l_linenumber AS productos_marca,
       CASE l_linenumber WHEN 2 THEN 'Part "' || l_partkey || '" | 2' WHEN 3 THEN 'Ñandú ' || l_partkey ELSE 'Part ' || l_partkey END AS productos_descripcion, printf('%.2f', l_extendedprice) AS productos_precio_lista, '' AS productos_leyenda_promo2
FROM l""")
def snapshot_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The price files of an archive of all order lines: quoted separators and quotes, null bytes, records over two lines,
    blank lines, notices, file names in other folders and cases."""
    blocks = snapshots.from_packages(_priced_packages(spark, sf_dir), ["productos.csv"])
    return snapshots.records(blocks, "productos.csv").select("source_package", "id_comercio", "id_sucursal", "id_producto", "productos_marca", "productos_descripcion", "productos_precio_lista", "productos_leyenda_promo2")


@query(f"""{_PACKAGE_SQL}, p AS (
    SELECT source_package, any_value(package) AS package, count(*) AS n, count(DISTINCT l_suppkey) AS stores, count(*) FILTER (WHERE l_linenumber = 3) AS nulls, count(*) FILTER (WHERE l_linenumber = 4) AS joined FROM l GROUP BY source_package
)
SELECT source_package, file_name, CASE file_name WHEN 'productos.csv' THEN n WHEN 'sucursales.csv' THEN stores ELSE 1 END AS source_rows, CASE file_name WHEN 'productos.csv' THEN n WHEN 'sucursales.csv' THEN stores ELSE 1 END AS loaded_rows,
       CASE file_name WHEN 'productos.csv' THEN package % 2 ELSE 0 END AS footer_rows, CASE file_name WHEN 'productos.csv' THEN nulls ELSE 0 END AS null_bytes_removed, CASE file_name WHEN 'productos.csv' THEN joined ELSE 0 END AS reconstructed_lines, 'success' AS status
FROM p, (SELECT unnest(['comercio.csv', 'sucursales.csv', 'productos.csv']) AS file_name)""")
def snapshot_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A load of that archive: the log of what the cleaning counted against the rows of the typed tables it wrote."""
    store = Warehouse(spark, f"{_shared(spark)}/gondola-load-{uuid.uuid4().hex}")
    log = snapshots.load_tables(snapshots.from_packages(_priced_packages(spark, sf_dir)), store.write, "run", "2026-08-02")
    return tidy(log.drop("ingest_run_id", "snapshot_date"))


def _shared(spark: SparkSession) -> str:
    """The folder all executors share."""
    return (spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_shared").rstrip("/")


def _broken_package(key: int) -> bytes:
    """A package with one fault, by the supplier's key; every tenth has none."""
    name, kind = "sucursales.csv", key % 10
    good = _csv(name, [[str(key), "1", "1"]])
    columns, row = list(COLUMNS[name]), "|".join(["x"] * 21)
    heads = {1: columns[1::-1] + columns[2:], 2: columns[1:], 3: [*columns, "extra"], 4: [*columns[:-1], columns[0]]}
    if kind in heads:
        return _zipped([(name, f"{'|'.join(heads[kind])}\n{row}\n".encode())])
    bodies = {5: b"", 6: "|".join(columns).encode()}
    files = [("a/" + name, bodies.get(kind, good))] if kind != 7 else [("other.csv", good)]
    return _zipped(files + [("b/" + name, good)] * (kind == 8) + [("zeros", b"0" * 400_000)] * (kind == 9))


@query("""SELECT 'package-' || s_suppkey || '.zip' AS source_package, CASE WHEN s_suppkey % 10 = 9 THEN NULL ELSE 'sucursales.csv' END AS file_name,
       CASE s_suppkey % 10 WHEN 1 THEN 'header: the columns are in another order' WHEN 2 THEN 'header: id_comercio is missing' WHEN 3 THEN 'header: extra is unknown'
            WHEN 4 THEN 'header: sucursales_domingo_horario_atencion is missing; id_comercio comes 2 times' WHEN 5 THEN 'empty file: no header' WHEN 6 THEN 'no data records'
            WHEN 7 THEN 'sucursales.csv: missing' WHEN 8 THEN 'sucursales.csv: more than one' ELSE 'zeros: suspicious compression ratio' END AS fault
FROM supplier WHERE s_suppkey % 10 <> 0""")
def snapshot_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What breaks the contract in an archive of a package for each supplier: headers, empty and missing members, a bomb."""
    make = F.udf(_broken_package, "binary")
    rows = adapter.read(spark, sf_dir, "supplier").select(F.format_string("package-%d.zip", "s_suppkey").alias("source_package"), make("s_suppkey").alias("content"))
    blocks = snapshots.from_packages(rows, ["sucursales.csv"], snapshots.Limits(ratio=100))
    return blocks.filter("fault IS NOT NULL").select("source_package", "file_name", "fault")


# Operators ------------------------------------------------------------------------------------------------------------


@query("SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS o_orderdate, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC NULLS LAST, o_orderkey DESC) = 1")
def latest_dim_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest row of each key, as the banner and store dimensions keep it."""
    rows = latest(adapter.read(spark, sf_dir, "orders"), ["o_custkey"], [F.desc_nulls_last("o_orderdate"), F.desc("o_orderkey")])
    return rows.select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("o_orderdate"), "o_orderstatus")


@query(r"""WITH v AS (SELECT p_partkey, upper(p_name) AS t FROM part), c AS (SELECT * FROM (VALUES ('A', '(^| )[A-M]', 'X|Z'), ('B', 'E.*E', '(^| )S'), ('C', '[0-9]', '0$')) x(category, inc, exc))
SELECT category, p_partkey, t AS description FROM v JOIN c ON regexp_matches(t, inc, 'i') AND NOT regexp_matches(t, exc, 'i')""")
def basket_candidate_regex_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptions against a short list of include and exclude patterns."""
    patterns = spark.createDataFrame([("A", "(^| )[A-M]", "X|Z"), ("B", "E.*E", "(^| )S"), ("C", "[0-9]", "0$")], "category string, inc string, exc string")
    rows = adapter.read(spark, sf_dir, "part").select("p_partkey", F.upper("p_name").alias("description"))
    return regex_join(rows, patterns, "description", "inc", "exc").select("category", "p_partkey", "description")


@query(r"""WITH v AS (SELECT p_partkey, p_type || ' ' || p_name AS description FROM part),
c AS (SELECT DISTINCT p_name AS pattern, '(^| )' || upper(split_part(p_name, ' ', 1)) || '.*' || split_part(p_name, ' ', 2) || '|' || p_type || ' [a-d]' AS inc, '^PROMO.*' || split_part(p_name, ' ', 1) AS exc FROM part
      UNION ALL SELECT DISTINCT p_brand, '[' || right(p_brand, 1) || 'x-z]', ' ' || lower(left(p_type, 1)) FROM part)
SELECT pattern, inc, exc, count(*) AS parts, min(p_partkey) AS first_part, max(p_partkey) AS last_part FROM v JOIN c ON regexp_matches(description, inc, 'i') AND NOT regexp_matches(description, exc, 'i') GROUP BY ALL""")
def pattern_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All descriptions against patterns made of all names and brands: the names' have pieces, the brands' have none. A
    description is tried once, whatever the number of parts that have it."""
    part = adapter.read(spark, sf_dir, "part")
    word = lambda k: F.get(F.split("p_name", " "), F.lit(k))
    names = part.select(F.col("p_name").alias("pattern"), F.concat(F.lit("(^| )"), F.upper(word(0)), F.lit(".*"), word(1), F.lit("|"), "p_type", F.lit(" [a-d]")).alias("inc"), F.concat(F.lit("^PROMO.*"), word(0)).alias("exc"))
    brands = part.select(F.col("p_brand").alias("pattern"), F.concat(F.lit("["), F.right("p_brand", F.lit(1)), F.lit("x-z]")).alias("inc"), F.concat(F.lit(" "), F.lower(F.left("p_type", F.lit(1)))).alias("exc"))
    texts = part.groupBy(F.concat("p_type", F.lit(" "), "p_name").alias("description")).agg(F.count(F.lit(1)).alias("n"), F.min("p_partkey").alias("low"), F.max("p_partkey").alias("high"))
    pairs = regex_join(texts, names.distinct().unionByName(brands.distinct()), "description", "inc", "exc")
    return tidy(pairs.groupBy("pattern", "inc", "exc").agg(F.sum("n").alias("parts"), F.min("low").alias("first_part"), F.max("high").alias("last_part")))


_CODE_SQL = r"""
WITH k AS (SELECT p_partkey, [8, 12, 13, 14, 7, 13][p_partkey % 6 + 1] AS n, CASE WHEN p_partkey % 5 = 0 THEN '2' ELSE '' END AS pre, CASE WHEN p_partkey % 7 = 0 THEN '0' ELSE 'Sí' END AS flag FROM part),
c AS (SELECT *, ' ' || rpad(pre || p_partkey::VARCHAR, n, '7') || ' ' AS code FROM k),
z AS (SELECT *, CASE WHEN lower(trim(flag)) IN ('1', 'true', 't', 'si', 'sí') AND regexp_full_match(trim(code), '[0-9]{8}|[0-9]{12}|[0-9]{13}|[0-9]{14}') THEN lpad(trim(code), 14, '0') END AS g FROM c),
y AS (SELECT *, coalesce(CAST(g[14] AS INT) = (10 - (list_sum([CAST(g[i] AS INT) * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END for i in range(1, 14)]) % 10)) % 10, false) AS ok FROM z)
SELECT p_partkey, code, flag, g AS gtin14, ok AS valid, CASE WHEN regexp_full_match(trim(code), '2[0-9]{7}|02[0-9]{10}|2[0-9]{12}|02[0-9]{12}') THEN 'RESTRICTED_LOCAL' WHEN flag = '0' THEN 'INTERNAL_LOCAL' WHEN ok THEN 'GLOBAL_GTIN' ELSE 'INVALID' END AS scope FROM y"""


@query(_CODE_SQL)
def gtin_normalize_validate_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of every length made from part keys: normalised, checked, classified."""
    key = F.col("p_partkey")
    size = F.array(*map(F.lit, (8, 12, 13, 14, 7, 13)))[(key % 6).cast("int")]
    code = F.concat(F.lit(" "), F.rpad(F.concat(F.when(key % 5 == 0, "2").otherwise(""), key.cast("string")), size, F.lit("7")), F.lit(" "))
    rows = adapter.read(spark, sf_dir, "part").select("p_partkey", code.alias("code"), F.when(key % 7 == 0, "0").otherwise("Sí").alias("flag"))
    rows = rows.withColumn("gtin14", codes.normalize_gtin14(F.col("code"), F.col("flag"))).withColumn("valid", codes.is_valid_gtin14(F.col("gtin14")))
    return rows.withColumn("scope", codes.classify(F.col("code"), codes.is_yes(F.col("flag")), F.col("valid")))


_UNIT_ROWS = [(f" {s.lower()} ", u) for u, names in units.ALIASES.items() for s in names.split()] + [("docena", "DOCENA"), ("  ", None), (None, None)]


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in row) + ")" for row in _UNIT_ROWS) + ") t(unit, normalized)")
def unit_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All spellings of the units, an unknown one, a blank and a null."""
    rows = spark.createDataFrame([(u,) for u, _ in _UNIT_ROWS], "unit string")
    return rows.withColumn("normalized", units.normalize_unit(F.col("unit")))


@query("SELECT doc_id, md5(upper(strip_accents(text))) AS folded_md5 FROM documents")
def text_fold_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapter.read(spark, sf_dir, "documents").select("doc_id", F.md5(text.folded_upper(F.col("text"))).alias("folded_md5"))


@query(f"WITH {_LINES} SELECT d AS snapshot_date, s AS id_sucursal, l_partkey AS part, count(*) AS rows FROM li GROUP BY ALL HAVING count(*) > 1")
def duplicate_grain_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys with more than one row, the check that lets the fact table stay a projection."""
    return facts.duplicate_grain(adapter.lines(spark, sf_dir).withColumnRenamed("l_partkey", "part"), ["snapshot_date", "id_sucursal", "part"])


@query("SELECT CAST(d AS DATE) AS date, CAST(r_regionkey AS BIGINT) AS region FROM range(DATE '2024-02-26', DATE '2024-03-04', INTERVAL 1 DAY) t(d) CROSS JOIN region")
def date_series_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every date of a range with every region."""
    dates = F.explode(F.sequence(F.lit("2024-02-26").cast("date"), F.lit("2024-03-03").cast("date")))
    return adapter.read(spark, sf_dir, "region").select(dates.alias("date"), F.col("r_regionkey").cast("long").alias("region"))


@query(f"WITH {_O} SELECT st.s AS id_sucursal, v.g AS gtin14 FROM st CROSS JOIN (SELECT unnest([{_BASKET_LIST}]) AS g) v LEFT JOIN (SELECT DISTINCT s, g FROM o WHERE year(d) = (SELECT max(year(d)) FROM o)) x ON x.s = st.s AND x.g = v.g WHERE x.g IS NULL")
def left_join_missing_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores that lack a basket product on the last date."""
    ctx = adapter.context(spark, sf_dir)
    wanted = adapter.stores(spark, sf_dir).select("id_sucursal", F.explode(F.array(*map(F.lit, adapter.BASKET))).alias("gtin14"))
    have = adapter.prices(spark, sf_dir).filter(F.col("snapshot_date") == F.lit(ctx.as_of)).select("id_sucursal", "gtin14", F.lit(True).alias("found"))
    return wanted.join(have, ["id_sucursal", "gtin14"], "left").filter(F.col("found").isNull()).drop("found")


@query("""WITH v AS (SELECT * FROM (VALUES ('O', DATE '1995-01-01', DATE '1997-06-30'), ('O', DATE '1997-07-01', NULL), ('F', DATE '1996-01-01', NULL), ('P', NULL, DATE '1998-01-01')) t(k, a, z))
SELECT o_orderkey, a AS valid_from, z AS valid_to FROM orders JOIN v ON o_orderstatus = k AND (a IS NULL OR CAST(o_orderdate AS DATE) >= a) AND (z IS NULL OR CAST(o_orderdate AS DATE) <= z)""")
def validity_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality with an open-ended validity range."""
    import datetime as dt

    d = dt.date
    valid = spark.createDataFrame([("O", d(1995, 1, 1), d(1997, 6, 30)), ("O", d(1997, 7, 1), None), ("F", d(1996, 1, 1), None), ("P", None, d(1998, 1, 1))], "o_orderstatus string, valid_from date, valid_to date")
    rows, day = adapter.read(spark, sf_dir, "orders").join(F.broadcast(valid), "o_orderstatus"), F.col("o_orderdate").cast("date")
    inside = (F.col("valid_from").isNull() | (day >= F.col("valid_from"))) & (F.col("valid_to").isNull() | (day <= F.col("valid_to")))
    return rows.filter(inside).select("o_orderkey", "valid_from", "valid_to")


@query("""SELECT p.o_orderkey, c.o_orderkey AS contract FROM orders p JOIN orders c ON p.o_custkey = c.o_custkey AND CAST(p.o_orderdate AS DATE) > CAST(c.o_orderdate AS DATE)
AND (c.o_orderkey % 50 = 0 OR CAST(p.o_orderdate AS DATE) <= CAST(c.o_orderdate AS DATE) + CAST(c.o_orderkey % 400 AS INTEGER))""")
def validity_range_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order opens a range of its customer, some without end: later orders with the ranges they fall in."""
    rows = adapter.read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", ranges.days(F.col("o_orderdate").cast("date")).alias("day"))
    until = F.when(F.col("o_orderkey") % 50 != 0, F.col("day") + F.col("o_orderkey") % 400)
    valid = rows.select("o_custkey", F.col("o_orderkey").alias("contract"), (F.col("day") + 1).alias("low"), until.alias("high"))
    return ranges.range_join(rows, valid, ["o_custkey"], "day", "low", "high").select("o_orderkey", "contract")


@query(f"""WITH {_LINES}, k AS (SELECT 'stores' AS what, d, b, s AS v FROM li UNION ALL SELECT 'products', d, b, CAST(l_partkey AS VARCHAR) FROM li UNION ALL SELECT 'orders', d, b, CAST(l_orderkey AS VARCHAR) FROM li)
SELECT what, CASE WHEN GROUPING(d) = 0 AND GROUPING(b) = 0 THEN 'BANNER_DAY' WHEN GROUPING(d) = 0 THEN 'DAY' WHEN GROUPING(b) = 0 THEN 'BANNER' ELSE 'NATIONAL' END AS level, d AS snapshot_date, b AS id_comercio, count(DISTINCT v) AS n
FROM k GROUP BY GROUPING SETS ((what, d, b), (what, d), (what, b), (what))""")
def distinct_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct stores, products and orders by banner and day, and merged from there over days, banners and the whole."""
    rows = adapter.lines(spark, sf_dir).select("snapshot_date", "id_comercio", F.col("id_sucursal").alias("stores"), F.col("l_partkey").alias("products"), F.col("l_orderkey").alias("orders"))
    by = ["snapshot_date", "id_comercio"]
    levels, out = {"BANNER_DAY": by, "DAY": by[:1], "BANNER": by[1:], "NATIONAL": []}, None
    for what in ("stores", "products", "orders"):
        maps = bitmaps.bitmaps(rows, by, what, bitmaps.dense_ids(rows, what))
        part = bitmaps.rolled_up(maps, levels, "n").select(F.lit(what).alias("what"), "level", *by, "n")
        out = part if out is None else out.unionByName(part)
    return tidy(out)


@query(f"WITH {_O} SELECT d AS snapshot_date, dayname(d) AS weekday, b AS id_comercio, count(*) AS prices, round(sum(x), 6) AS total FROM o WHERE dayname(d) IN ('Monday', 'Friday') GROUP BY ALL")
def semantic_star_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices on two weekdays, from a table stored by date: the calendar decides which dates are opened."""
    folder = f"{_shared(spark)}/gondola-star-{uuid.uuid4().hex}"
    semantic.write_star(registry.Tables(prices=adapter.prices(spark, sf_dir).drop("build_id")), folder)
    rows = semantic.read_star(spark, folder, "prices", F.col("weekday").isin("Monday", "Friday"))
    return tidy(rows.groupBy("snapshot_date", "weekday", "id_comercio").agg(F.count(F.lit(1)).alias("prices"), F.sum("list_price").alias("total")))


@query("SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(l_extendedprice, 6) AS l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC NULLS LAST, l_orderkey, l_linenumber LIMIT 100")
def topn_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted sample with nulls last: the limit is the feature."""
    rows = adapter.read(spark, sf_dir, "lineitem").orderBy(F.desc_nulls_last("l_extendedprice"), "l_orderkey", "l_linenumber").limit(100)
    return tidy(rows.select("l_orderkey", "l_linenumber", "l_extendedprice"))


@query(f"WITH {_D} SELECT {_ENTITY_OUT} FROM ent WHERE lv = 'BANNER' AND st = 'PUBLISHABLE' AND d = (SELECT max(d) FROM ent WHERE lv = 'BANNER' AND st = 'PUBLISHABLE')")
def latest_publishable_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last date within the publishable rows of a level, which may be earlier than the last date."""
    return tidy(exports.latest_publishable(built("mart_dispersion_entity_daily", spark, sf_dir).filter("dispersion_level = 'BANNER'")))


@query(f"""WITH {_B}, m AS (SELECT max(d) AS d FROM sb) SELECT round(median(md) FILTER (WHERE st = 'PUBLISHABLE'), 6) AS costo_canasta, CAST(sum(c) AS BIGINT) AS sucursales_completas, round(sum(c) / sum(n), 6) AS completitud FROM sb WHERE d = (SELECT d FROM m)""")
def semantic_basket_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three measures at the last date."""
    t = registry.Tables(basket_banner=built("mart_basket_banner_daily", spark, sf_dir))
    names = {"costo_canasta_ultimo_corte": "costo_canasta", "sucursales_canasta_completa": "sucursales_completas", "completitud_canasta": "completitud"}
    one, two, three = (semantic.measure(t, k).withColumnRenamed(k, v).withColumn("one", F.lit(1)) for k, v in names.items())
    return tidy(one.join(two, "one").join(three, "one").drop("one"))


@query(f"WITH {_REL} SELECT d AS snapshot_date, round(100 * exp(avg(ln(v / 100))), 6) AS center, min(n) AS smallest_panel, max(n) AS largest_panel FROM idx GROUP BY d")
def index_centre_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The geometric centre of the index is 100 and all banners have one panel, each day."""
    df = built("mart_banner_index_daily", spark, sf_dir)
    return tidy(df.groupBy("snapshot_date").agg((100 * F.exp(F.avg(F.ln(F.col("price_index") / 100)))).alias("center"), F.min("common_gtins").alias("smallest_panel"), F.max("common_gtins").alias("largest_panel")))


@query(f"""WITH {_B} SELECT d AS snapshot_date, b AS id_comercio, CAST(8 - f AS BIGINT) AS missing_components, count(*) AS stores FROM bs WHERE f < 8 GROUP BY ALL""")
def incomplete_basket_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(exports.incomplete_baskets(built("mart_basket_store_daily", spark, sf_dir)).drop("basket_version", "id_bandera"))


@query(f"WITH {_D} SELECT d AS snapshot_date, lv AS dispersion_level, st AS coverage_status, count(*) AS products FROM disp GROUP BY ALL")
def dispersion_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tidy(exports.dispersion_coverage(built("mart_price_dispersion_daily", spark, sf_dir)))


_EVENT_JUMPS = """WITH e AS (SELECT CAST(ts AS DATE) AS d, user_id, event_type, value FROM events), u AS (SELECT user_id, event_type, d, median(value) AS v FROM e WHERE value > 0 GROUP BY ALL),
l AS (SELECT *, lag(d) OVER w AS pd, lag(v) OVER w AS pv FROM u WINDOW w AS (PARTITION BY user_id, event_type ORDER BY d))
SELECT user_id, event_type, d AS day, v / pv AS ratio FROM l WHERE date_diff('day', pd, d) = 1 AND v / pv NOT BETWEEN 0.5 AND 2"""


@query(_EVENT_JUMPS.replace("v / pv AS ratio", "round(v / pv, 6) AS ratio"))
def event_daily_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day-over-day jumps of a series, on the event table."""
    daily = adapter.read(spark, sf_dir, "events").filter("value > 0").groupBy("user_id", "event_type", F.col("ts").cast("date").alias("day")).agg(F.median("value").alias("v"))
    w = Window.partitionBy("user_id", "event_type").orderBy("day")
    rows = daily.withColumns({"before": F.lag("day").over(w), "pv": F.lag("v").over(w)}).filter(F.datediff("day", "before") == 1)
    return tidy(rows.withColumn("ratio", F.col("v") / F.col("pv")).filter("ratio < 0.5 OR ratio > 2").select("user_id", "event_type", "day", "ratio"))


@query("SELECT user_id, event_type, day, round(ratio, 6) AS ratio FROM (" + _EVENT_JUMPS + ")")
def event_jumps_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream: files of events in no order of time, a few a batch, so every day is kept."""
    folder = f"{_shared(spark)}/gondola-jumps-{uuid.uuid4().hex}"
    events = adapter.read(spark, sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("date").alias("day"), "value")
    events.repartition(24, F.xxhash64("user_id", "event_type", "value")).write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 8).parquet(f"{folder}/in")
    series = ["user_id", "event_type"]
    jumps.publish(jumps.jumps(stream, series, "day", "value", keep=None), f"{folder}/out", f"{folder}/state").awaitTermination()
    return tidy(jumps.current(spark, f"{folder}/out", series))
