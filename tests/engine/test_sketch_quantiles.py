"""Exact quantiles and ranks at several levels at once: what is shuffled is what lies near them."""

import duckdb
import pytest
from pyspark.sql import functions as F

from gondola.functions.selection import asked, picked, ranged
from gondola.queries import ORACLES, QUERIES

TABLES = ["part", "supplier", "nation", "region", "lineitem"]


def _tables(spark, folder, lines):
    spark.sql("SELECT id AS p_partkey, 'p' AS p_name, IF(id = 3, NULL, concat('Brand#', id % 2)) AS p_brand, 1 AS p_size, 't' AS p_type FROM range(5)").write.parquet(f"{folder}/part.parquet")
    spark.sql("SELECT id AS s_suppkey, 's' AS s_name, id % 3 AS s_nationkey FROM range(6)").write.parquet(f"{folder}/supplier.parquet")
    spark.sql("SELECT id AS n_nationkey, IF(id = 2, NULL, concat('N', id)) AS n_name, id % 2 AS n_regionkey FROM range(3)").write.parquet(f"{folder}/nation.parquet")
    spark.sql("SELECT id AS r_regionkey, concat('R', id) AS r_name FROM range(2)").write.parquet(f"{folder}/region.parquet")
    price = "IF(id % 5 = 4 AND id % 6 = 1 OR id % 97 = 0, NULL, power(2D, (id * 7919 % 1000003) / 100000D))"
    spark.sql(f"SELECT id AS l_orderkey, id % 5 AS l_partkey, id % 6 AS l_suppkey, 1 AS l_linenumber, 2D AS l_quantity, {price} AS l_extendedprice, 0D AS l_discount, 0D AS l_tax, 'A' AS l_returnflag, TIMESTAMP'2024-01-05 00:00:00' + make_interval(int(id % 3)) AS l_shipdate FROM range({lines})").coalesce(2).write.parquet(f"{folder}/lineitem.parquet")
    duck = duckdb.connect()
    for name in TABLES:
        duck.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet/*.parquet')")
    return duck


def _shuffled(spark):
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    empty = gateway.jvm.java.util.ArrayList
    stages = store.stageList(empty(), False, False, gateway.new_array(gateway.jvm.double, 0), empty())
    return sum(stages.apply(k).shuffleWriteRecords() for k in range(stages.size()))


def test_few_rows_are_shuffled(spark, tmp_path):
    """Of prices that all differ only those near a quantile are; null brands, provinces and prices are as in the SQL."""
    lines = 400_000
    duck = _tables(spark, tmp_path, lines)
    before = _shuffled(spark)
    found = QUERIES["sketch_quantiles"](spark, str(tmp_path)).collect()
    assert _shuffled(spark) - before < 2 * lines  # one join shuffles them all
    columns = ["dispersion_level", "gtin14", "id_comercio", "provincia_codigo", "n", "price_median", "price_p10", "price_p90"]
    truth = duck.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES['sketch_quantiles']})").fetchall()
    assert sorted(map(str, ([r[c] for c in columns] for r in found))) == sorted(str(list(r)) for r in truth) and any(r[1] is None for r in truth)
    spark.catalog.clearCache()


@pytest.mark.parametrize("few", [True, False])
def test_levels_against_brute_force(spark, few):
    """Equal, negative, zero and missing values; groups of one, of nulls only, of a null key; guesses right and wrong."""
    rows = spark.sql("SELECT IF(id % 5 = 0, NULL, id % 5) AS a, IF(id % 3 = 0, NULL, id % 3) AS b, CASE WHEN id % 5 = 2 OR id % 11 = 0 THEN NULL WHEN id % 4 = 0 THEN id % 20 - 10 ELSE (id * 37 % 101) / 7 - 3 END AS v FROM range(400)").select("a", "b", F.col("v").cast("double").alias("v"))
    rows = rows.union(spark.sql("SELECT 99L, 1L, 5D")).repartition(5)
    keys, levels, shares = ["a", "b"], {"ALL": [], "A": ["a"], "AB": ["a", "b"]}, [0.5, 0.1]
    parts = []
    for k, own in enumerate(levels.values()):
        held = [F.col(c) if c in own else F.lit(None).cast("long").alias(c) for c in keys]
        parts.append(rows.select(F.lit(k).alias("__level"), *held, "v").groupBy("__level", *keys).agg(F.count("*").alias("n"), F.sort_array(F.collect_list("v")).alias("all"), F.percentile("v", F.array(*map(F.lit, shares))).alias("quantiles")))
    truth = parts[0].union(parts[1]).union(parts[2]).withColumn("guesses", F.when(F.size("all") > 0, F.array(F.col("all")[F.floor(F.size("all") / 3).cast("int")], F.col("all")[F.size("all") - 1])))
    counts = ranged(rows, keys, "v")
    hit = asked(counts, keys, levels, shares, truth.select("__level", *keys, "guesses"))
    found = {tuple(r)[:3]: r for r in picked(rows, counts, hit, keys, levels, "v", shares, few).collect()}
    for r in truth.collect():
        own = found.pop((r["__level"], r.a, r.b))
        assert (own.n, own.total) == (r.n, len(r.all))
        if r.all:
            assert own.quantiles == pytest.approx(r.quantiles, abs=1e-12) and own.guesses == r.guesses
            assert own.below == [sum(v < g for v in r.all) for g in r.guesses] and own.upto == [sum(v <= g for v in r.all) for g in r.guesses]
        else:
            assert own.quantiles == [None, None]
    assert not found
