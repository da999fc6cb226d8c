"""Tables that are read more than once are kept in order and computed once; the store dimension doesn't pass the driver."""

from pyspark.sql import functions as F

from gondola.functions.codes import GLOBAL_GTIN
from gondola.functions.selection import medians_of
from gondola.plans import registry, semantic
from gondola.queries import QUERIES, _checked
from gondola.sources import adapter

SF = "/root/testdata/sf0.001"


def test_inputs_are_kept_first(spark, monkeypatch):
    ctx = adapter.context(spark, SF)
    kept = []
    monkeypatch.setattr(registry, "keep_table", lambda df: kept.append(df) or df)
    tables = registry.build(ctx, adapter.sources(spark, SF, ctx), keep=True)
    names = [next(n for n, df in tables.items() if df is k) for k in kept]
    assert len(names) > 3
    for at, name in enumerate(names):
        reached, stack = set(), [name]
        while stack:
            mart = registry.load().get(stack.pop())
            new = set(mart.needs) - reached if mart else set()
            reached |= new
            stack += new
        assert not (reached - {name}) & set(names[at + 1 :])


def test_store_dimension_is_shuffled(spark):
    ctx = adapter.context(spark, SF)
    t = registry.build(ctx, adapter.sources(spark, SF, ctx), {"fct_analysis_price_store_daily"})
    plan = t["fct_analysis_price_store_daily"]._jdf.queryExecution().optimizedPlan().toString()
    assert "rightHint=(strategy=merge)" in plan


def test_last_date_reads_its_table_once(spark):
    leaves = QUERIES["index_extremes"](spark, SF)._jdf.queryExecution().withCachedData().collectLeaves()
    assert {leaves.apply(k).nodeName() for k in range(leaves.size())} == {"InMemoryRelation"}
    registry.release()
    rows = spark.sql("SELECT DATE'2020-01-01' + CAST(id % 3 AS INT) AS snapshot_date, 'PUBLISHABLE' AS coverage_status, 'BANNER' AS dispersion_level, CAST(id % 2 AS STRING) AS banner_label, id AS publishable_products, CAST(id AS DOUBLE) AS median_dispersion_clean FROM range(12)")
    t = registry.Tables(dispersion_entity=rows)
    for by, found in ((None, [(26,)]), (["banner_label"], [("0", 10), ("1", 16)])):
        out = semantic.measure(t, "productos_dispersion_publicables", by)
        assert "Join" not in out._jdf.queryExecution().analyzed().toString() and sorted(map(tuple, out.collect())) == found
    none = registry.Tables(dispersion_entity=rows.filter("snapshot_date IS NULL"))
    assert [tuple(r) for r in semantic.measure(none, "dispersion_limpia").collect()] == [(None,)]


def test_what_the_gates_read_too_is_kept(spark):
    _, t = _checked(spark, SF)
    assert all(t[n].storageLevel.useMemory for n in ("quality_price_anomaly_daily", "mart_quality_daily"))
    registry.release()


def test_small_medians_gather_nothing(spark):
    plan = adapter.prices(spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "percentile" not in plan
    df = spark.sql("SELECT IF(id % 7 = 0, NULL, id % 40) AS k, IF(id % 11 = 0 OR id % 40 = 3, NULL, CAST(id * 7919 % 1013 AS DOUBLE) / 3) AS v FROM range(300)")
    found = medians_of(df, ["k"], "v", "m").join(df.groupBy(F.col("k").alias("l")).agg(F.median("v").alias("b")), F.col("k").eqNullSafe(F.col("l"))).collect()
    assert len(found) == 41 and all(r.m == r.b or abs(r.m - r.b) < 1e-9 for r in found) and any(r.m is None for r in found)


def test_variants_are_not_sorted_by_row(spark):
    ctx = adapter.context(spark, SF)
    sources = adapter.sources(spark, SF, ctx)
    own = registry.build(ctx, sources, {"agg_product_variant_daily"})["agg_product_variant_daily"]
    plan = own._jdf.queryExecution().sparkPlan().toString()
    assert plan[: plan.rindex("Aggregate(")].endswith("Hash")
    keys = [c for c in own.columns if c not in ("observations", "last_package")]
    plain = sources["fact_price"].filter(F.col("product_code_scope") == GLOBAL_GTIN).withColumn("build_id", F.lit(ctx.build_id)).groupBy(*keys).agg(F.count(F.lit(1)).alias("observations"), F.max("source_package").alias("last_package"))
    assert own.count() == plain.count() and own.exceptAll(plain.select(own.columns)).isEmpty()
