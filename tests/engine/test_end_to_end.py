import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from gondola.plans import build as building
from gondola.plans import exports, gates, semantic, sinks, validate
from gondola.plans.registry import Tables
from gondola.plans.warehouse import Warehouse
from gondola.sources import snapshots
from gondola.sources.contract import ContractError
from gondola.streaming import landing
from tests.engine import synthetic as s

TODAY = dt.date(2026, 8, 3)


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("shop")
    for date in s.DATES:
        s.archive(root / "raw", date, more={f"{date}/x_comercio-sepa-36_{date}.zip": b""} if date == s.DATES[0] else None)
    store = Warehouse(spark, root / "warehouse")
    landing.watch(spark, str(root / "raw"), store, str(root / "checkpoint")).awaitTermination()
    ctx = building.build(store, today=TODAY)
    return root, store, ctx, building.published(store, TODAY)[1]


def test_marts_of_the_window(built):
    _, _, ctx, t = built
    assert t["mart_price_product_daily"].select("snapshot_date").distinct().count() == 7
    index = t["mart_banner_index_daily"]
    assert index.agg(F.min("common_gtins"), F.max("common_gtins")).first()[:] == (8, 8) and not index.filter("publishable").count()
    assert all(abs(r.center - 100) < 1e-9 for r in exports.index_centre(t).collect())
    median = t["mart_basket_banner_daily"].filter("id_comercio = '12' AND snapshot_date = '2026-08-02'").first()
    assert float(median.branch_median_cost) == 9069.12 and median.coverage_status == "PUBLISHABLE"
    assert t["mart_price_dispersion_daily"].count() == 7 * 8 * 16
    assert t["fct_global_price_store_daily"].count() == 7840 and t["dim_product_asof"].count() == 8
    assert t["mart_product_persistence_7d"].filter("strict_persistent_7d").count() == 56
    review = t["mart_basket_candidate_review"].filter("selected_component")
    assert review.count() == 8 and review.filter("semantic_match AND presentation_match").count() == 8


def test_gates_grade_and_lineage(built):
    _, _, ctx, t = built
    checks = {r.test_name: r.failed_rows for r in t["quality_checks"].collect()}
    assert set(checks) == set(gates.GATES) and len(checks) == 25
    assert {k for k, v in checks.items() if v} == {"known_empty_source_packages"}
    assert validate.validate(ctx, t, TODAY).grade == "Media"
    broken = Tables(t, quality_checks=t["quality_checks"].filter("test_name <> 'stale_as_of_date'"))
    assert not validate.validate(ctx, broken, TODAY).usable
    with pytest.raises(validate.ValidationError):
        seen = []
        validate.checked(ctx, broken, seen.append, TODAY)
    assert seen


def test_exports_and_measures(built, tmp_path, spark):
    _, store, ctx, t = built
    (tmp_path / "portfolio").mkdir()
    for name in ("basket_summary", "of_the_user"):
        (tmp_path / "portfolio" / f"{name}.csv").write_text("x")
    sinks.export_all(ctx, t, tmp_path / "out", tmp_path / "portfolio", TODAY)
    assert (tmp_path / "portfolio" / "of_the_user.csv").exists() and not (tmp_path / "portfolio" / "basket_summary.csv").exists()
    (tmp_path / "portfolio" / "of_the_user.csv").unlink()
    page = (tmp_path / "out" / "dashboard.html").read_text(encoding="utf-8")
    assert page.count("<svg") + page.count("Nothing to show") == 6 and "Healthy banner-days" in page
    back = sinks.read_exports(spark, str(tmp_path / "out" / "csv"), t, ctx)
    for name, view in exports.VIEWS.items():
        seen, kept = view(ctx, t), back[name]
        assert kept.dtypes == seen.dtypes and kept.count() == seen.count()
    assert {r.gtin14 for r in back["basket_definition"].collect()} == {r.gtin14 for r in t["dim_basket_component"].collect()}
    keys = ["snapshot_date", "id_comercio", "id_bandera", "price_index", "common_gtins", "publishable"]
    assert sorted(map(tuple, back["index_daily"].select(*keys).collect())) == sorted(map(tuple, t["mart_banner_index_daily"].select(*keys).collect()))
    assert {p.stem for p in (tmp_path / "portfolio").glob("*.csv")} == set(exports.VIEWS) and (tmp_path / "out" / "summary.xlsx").stat().st_size > 1000
    views = Tables({k: v(ctx, t) for k, v in exports.VIEWS.items()})
    values = {k: semantic.measure(views, k).first()[0] for k in semantic.measures()}
    assert len(values) == 17 and values["gtin_comunes_ultimo_dia"] == 8 and values["sucursales_canasta_completa"] == 140 and values["completitud_canasta"] == 1.0 and values["salud_cadena_dia"] == 1.0
    assert semantic.measure(views, "indice_semanal", ["banner_label"]).count() == 7
    assert [r.date.isoformat() for r in semantic.calendar(views).orderBy("date").collect()] == s.DATES
    assert semantic.on_calendar(views, "quality_daily").filter("year = 2026").count() == 7
    t = Tables(t, snapshot_state=store.snapshot_table(), pipeline_runs=store.runs_table())
    assert exports.lineage_drift(ctx, t).count() == 0 and exports.missing_index_dates(ctx, t).count() == 0 and exports.failed_runs(t).count() == 0
    assert exports.unhealthy(t).count() == 0 and exports.failed_gates(t).count() == 1 and exports.basket_validation(t).count() == 7


def test_failures_leave_the_published_build(built, spark):
    root, store, ctx, _ = built
    before = store.published
    with pytest.raises(RuntimeError):
        building.build(store, today=TODAY, fail_after="dim_store_daily")
    assert store.published == before and [r["status"] for r in store.runs().values()][-1] == "failed"
    with pytest.raises(ValueError):
        building.build(store, dt.date(2026, 8, 1), today=TODAY)
    path, date = root / "raw" / s.DATES[0] / "sepa_x.zip", s.DATES[0]
    run = store.snapshots[date]["run_id"]
    assert snapshots.load(store, str(path), date) == run
    other = s.archive(root / "other", date, change=lambda k, f: f.pop("productos.csv") if k == 1 else None)
    with pytest.raises(ContractError):
        snapshots.load(store, str(other), date)
    with pytest.raises(Exception, match="missing"):
        snapshots.load(store, str(other), date, force=True)
    assert store.snapshots[date]["run_id"] == run
    assert snapshots.load(store, str(path), date, force=True) != run


def rows_of(table, name):
    drop = ["build_id", *(["ingest_run_id", "raw_sha256"] if name == "build_inputs" else [])]
    drop += ["driver_rank"] if name == "mart_banner_index_driver_daily" else []  # contributions that differ in their last bits only
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    return sorted(str([plain(v) for v in r]) for r in table.drop(*drop).collect())


def test_a_new_day_computes_that_day_only(built):
    """A build whose window ends a day later, while older prices can't be read: equal to a whole build."""
    root, store, first, _ = built
    tomorrow = "2026-08-03"
    snapshots.load(store, str(s.archive(root / "raw", tomorrow)), tomorrow)
    raw = [Path(store.place("sources", state["run_id"], name)) for date, state in store.snapshots.items() if date != tomorrow for name in ("fact_price", "store_snapshot", "commerce_snapshot")]
    for path in raw:
        path.rename(path.with_name("hidden_" + path.name))
    second = building.build(store, today=TODAY)
    for path in raw:
        path.with_name("hidden_" + path.name).rename(path)
    made = {}
    for key, folder in store.commits.state().partitions.items():
        if folder.endswith(second.build_id):
            made.setdefault(key.split("/")[0], []).append(key.split("/")[1])
    assert made["fct_global_price_store_daily"] == made["mart_quality_daily"] == made["agg_product_variant_daily"] == [tomorrow]
    assert sorted(made["quality_price_anomaly_daily"]) == ["2026-07-28", tomorrow]  # the window's first date has lost the one before
    assert store.published["build_id"] == second.build_id != first.build_id
    whole = building.build(store, today=TODAY, fresh=True)
    found, expected = store.build_tables(second.build_id), store.build_tables(whole.build_id)
    assert set(found) == set(expected) and len(found) > 35
    assert {n: t.dtypes for n, t in found.items()} == {n: t.dtypes for n, t in expected.items()}
    other = {n: [x for x in zip(rows_of(found[n], n), rows_of(expected[n], n)) if x[0] != x[1]][:1] for n in expected if rows_of(found[n], n) != rows_of(expected[n], n)}
    assert other == {}


def test_a_lost_row_fails_the_load(spark, tmp_path, monkeypatch):
    date = s.DATES[0]
    path = s.archive(tmp_path / "raw", date, banners=[0, 1], more={f"{date}/x_comercio-sepa-36_{date}.zip": b""})
    store = Warehouse(spark, tmp_path / "warehouse")
    whole = snapshots.LOADERS["productos.csv"]
    monkeypatch.setitem(snapshots.LOADERS, "productos.csv", lambda rows, *a: whole(rows, *a).filter("NOT (id_comercio = '12' AND id_sucursal = '7' AND gtin14 = '07790742363008')"))
    with pytest.raises(ContractError, match="320 records, 319 loaded"):
        snapshots.load(store, str(path), date)
    assert not store.snapshots
    monkeypatch.undo()
    run = snapshots.load(store, str(path), date)
    log = store.read("sources", run, "ingestion_log")
    assert sorted((r.file_name, r.source_rows, r.loaded_rows, r.footer_rows, r.status) for r in log.collect()) == sorted(
        [("", 0, 0, 0, "source_empty"), *[("comercio.csv", 1, 1, 1, "success")] * 2, *[("sucursales.csv", 20, 20, 1, "success")] * 2, *[("productos.csv", 160, 160, 1, "success")] * 2]
    )
    plan = snapshots.scan(spark, str(path), date, "productos.csv")._jdf.queryExecution().executedPlan().toString()
    assert "from_csv" in plan and plan.count("BatchScan") + plan.count("Scan gondola") >= 1


def test_store_boundary_and_geography(spark, tmp_path):
    def change(k, files):
        if k in (0, 1, 2):
            for row in files["sucursales.csv"]:
                row[13] = ""

    def last(k, files):
        change(k, files)
        if k == 1:
            for row in files["productos.csv"]:
                if row[2] == "20":
                    row[9] = "0"

    for date in s.DATES:
        s.archive(tmp_path / "raw", date, last if date == s.DATES[-1] else change)
    store = Warehouse(spark, tmp_path / "warehouse")
    for date, path in snapshots.discover(tmp_path / "raw").items():
        snapshots.load(store, path, date)
    ctx = building.build(store, today=TODAY)
    t = building.published(store)[1]
    bad = "(provincia_codigo IS NULL OR provincia_codigo NOT LIKE 'AR-%') AND coverage_status = 'PUBLISHABLE'"
    assert not t["mart_basket_province_daily"].filter(bad).count() and not t["mart_dispersion_entity_daily"].filter(f"dispersion_level LIKE '%PROVINCE' AND {bad}").count()
    assert {r.coverage_status for r in t["mart_basket_province_daily"].filter("provincia_codigo IS NULL").collect()} == {"INVALID_GEOGRAPHY"}
    rows = {str(r.snapshot_date): r for r in t["mart_basket_banner_daily"].filter("id_comercio = '12'").collect()}
    assert (rows["2026-08-01"].complete_stores, rows["2026-08-01"].coverage_status) == (20, "PUBLISHABLE")
    assert (rows["2026-08-02"].complete_stores, rows["2026-08-02"].coverage_status) == (19, "DIRECTIONAL")
    assert ctx.days == 7


def test_repeated_grain(spark, tmp_path):
    for date in s.DATES:
        s.archive(tmp_path / "raw", date, lambda k, f: f["productos.csv"].append(f["productos.csv"][0]) if k == 0 and date == s.DATES[3] else None, banners=[0])
    store = Warehouse(spark, tmp_path / "warehouse")
    for date, path in snapshots.discover(tmp_path / "raw").items():
        snapshots.load(store, path, date)
    with pytest.raises(building.GrainError):
        building.build(store, today=TODAY)
    assert store.published is None
