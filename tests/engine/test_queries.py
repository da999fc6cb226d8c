"""Registered queries against their SQL in DuckDB, on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from gondola.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
CHECKED = [
    "price_index_daily", "index_sensitivity", "pair_overlap", "banner_day_health_grid", "anomaly_union", "basket_savings", "quality_daily_counts", "local_code_medians", "representative_variant_dedup", "basket_candidate_review", "latest_dim_dedup",
    "gtin_normalize_validate_classify", "unit_normalize", "text_fold_accents", "duplicate_grain_probe", "date_series_grid", "left_join_missing_audit", "validity_range_join", "topn_sample", "event_daily_jumps",
    "quality_gates_failing", "published_basket_components", "export_basket_definition", "measure_dispersion_limpia_of_provinces", "ingestion_reconciliation", "typed_commerce", "typed_stores", "typed_prices", "snapshot_scan", "snapshot_metrics", "snapshot_faults", "streaming_median_error", "sketch_quantiles", "failed_runs", "published_state", "price_quantiles", "basket_candidate_regex_join",
    "pattern_candidates", "validity_range_blocks", "distinct_rollup", "semantic_star_pruned", "event_jumps_stream",
]


def rows(frame):
    frame = frame[sorted(frame.columns)]
    frame = frame.astype(object).where(frame.notna(), None)
    return sorted(tuple(str(v).removesuffix(" 00:00:00") for v in r) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in TABLES:
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    return c


@pytest.mark.parametrize("name", CHECKED)
def test_query(spark, duck, name):
    found, truth = QUERIES[name](spark, SF).toPandas(), duck.sql(ORACLES[name]).df()
    assert sorted(found.columns) == sorted(truth.columns) and rows(found) == rows(truth)
    spark.catalog.clearCache()


def test_entry(spark):
    assert entry.entry(spark).count() == 35 and set(ORACLES) == set(QUERIES) and set(QUERIES) <= set(entry.queries())


def test_patterns_try_a_description_once(spark):
    """Equal descriptions are counted before the join: their number, not the parts', is what the expressions see."""
    plan = QUERIES["pattern_candidates"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join ") :]
    assert "min(p_partkey" in join and "max(p_partkey" in join
    assert not any("Filter" in line and "substring" in line for line in plan.splitlines())
