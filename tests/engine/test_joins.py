"""Range joins, pattern joins, bitmaps, date-partitioned tables and jumps on a stream, against brute force."""

import datetime as dt
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gondola.functions.text import matches
from gondola.operators import bitmaps, patterns, ranges
from gondola.plans import semantic
from gondola.plans.registry import Tables
from gondola.streaming import jumps


def plan(df):
    return df._jdf.queryExecution().toString()


def test_range_join(spark):
    """Open, empty and repeated ranges, repeated points, nulls, and a key that holds most rows."""
    rng = random.Random(5)
    key = lambda: rng.choice(["a"] * 6 + ["b", "c", None])
    points = [(key(), rng.choice([None, *range(-300, 300)]), i % 90) for i in range(400)]
    spans = [(key(), rng.choice([None, *range(-400, 400)]), 0, i % 70) for i in range(200)]
    spans = [(k, a, None if i % 9 == 0 else (a or 0) + rng.choice([-3, 0, 1, 15, 16, 17, 255, 256, 700]), n) for i, (k, a, _, n) in enumerate(spans)]
    truth = Counter((k, p, n, a, z, m) for k, p, n in points for j, a, z, m in spans if k is not None and k == j and p is not None and (a is None or p >= a) and (z is None or p <= z))
    found = ranges.range_join(spark.createDataFrame(points, "k string, at long, n int"), spark.createDataFrame(spans, "k string, low long, high long, m int"), ["k"], "at", "low", "high")
    assert found.columns == ["k", "at", "n", "low", "high", "m"] and Counter(map(tuple, found.collect())) == truth and sum(truth.values()) > 5000


@pytest.mark.parametrize("points,spans", [([], [("a", 1, 2)]), ([("a", None)], [("a", 1, 2)]), ([("a", 1)], []), ([("a", 5)], [("a", 7, 6), ("b", None, None)])])
def test_range_join_without_rows(spark, points, spans):
    found = ranges.range_join(spark.createDataFrame(points, "k string, at long"), spark.createDataFrame(spans, "k string, low long, high long"), ["k"], "at", "low", "high")
    assert found.columns == ["k", "at", "low", "high"] and found.count() == 0


def test_range_blocks(spark):
    """The blocks of a range cover it once each, and are few."""
    cases = [(0, 1), (3, 3), (15, 17), (0, 256), (1, 4095), (0, 16**6 + 5), (17, 16**5 - 1)]
    for a, z in cases:
        found = spark.range(1).select(ranges.blocks(F.lit(a).cast("long"), F.lit(z).cast("long")).alias("b")).first().b
        spans = sorted((b.block * 16**b.level, (b.block + 1) * 16**b.level) for b in found)
        assert len(found) <= 30 * 7 and [s for s, _ in spans] == [a, *[e for _, e in spans]][: len(spans)] and (spans[-1][1] if spans else a) == max(a, z)


def test_many_ranges(spark):
    """A million validity ranges: no nested loop, and the join's rows are those of the result."""
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").select("o_orderkey", (F.col("o_orderkey") % 7).alias("k"), ranges.days(F.col("o_orderdate").cast("date")).alias("day"))
    first = dt.date(1900, 1, 1).toordinal() - dt.date(1970, 1, 1).toordinal()
    valid = spark.range(1_000_000).select((F.col("id") % 7).alias("k"), (F.lit(first) + F.col("id") % 80_000).alias("low"), (F.lit(first) + F.col("id") % 80_000 + F.col("id") % 3).alias("high"), "id")
    found = ranges.range_join(orders, valid, ["k"], "day", "low", "high").groupBy("k", "day").agg(F.count(F.lit(1)).alias("n"))
    text = plan(found)
    assert "NestedLoop" not in text and "Cartesian" not in text
    daily = valid.select("k", F.explode(F.sequence("low", "high")).alias("day")).groupBy("k", "day").agg(F.count(F.lit(1)).alias("w"))
    truth = orders.groupBy("k", "day").agg(F.count(F.lit(1)).alias("c")).join(daily, ["k", "day"]).select("k", "day", (F.col("w") * F.col("c")).alias("n"))
    assert found.exceptAll(truth).count() == 0 and truth.exceptAll(found).count() == 0 and truth.count() > 1000


def test_ranges_are_not_broadcast(spark):
    """A small file of long ranges makes many blocks: they are shuffled, and a range of 400 has a dozen."""
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").select("o_custkey", "o_orderkey", ranges.days(F.col("o_orderdate").cast("date")).alias("day"))
    valid = orders.select("o_custkey", F.col("o_orderkey").alias("n"), F.col("day").alias("low"), (F.col("day") + 399).alias("high"))
    text = ranges.range_join(orders, valid, ["o_custkey"], "day", "low", "high")._jdf.queryExecution().sparkPlan().toString()
    assert any("SortMergeJoin" in line and "block" in line for line in text.splitlines()) and not any("BroadcastHashJoin" in line and "block" in line for line in text.splitlines())
    sizes = spark.range(1000).select(F.size(ranges.blocks(F.col("id") * 7, F.col("id") * 7 + 400, ranges.JOIN_FAN, 4)).alias("n")).agg(F.avg("n")).first()[0]
    assert sizes < 13


@pytest.mark.parametrize("pattern,expected", [("AZUCAR", ["azu"]), ("(^| )AZUCAR( |$)", ["azu"]), ("CAFE.*MOLIDO|INSTANT", ["caf", "ins"]), ("(ab|cd)+", [""]), ("(abc)?x", [""]), ("(abc|defg){1,2}", [""]), ("(abc|defg)+", ["abc", "def"]), (r"L\\.V", [""]), ("[0-9]", [""]), ("", [""]), ("ab*cde", ["cde"]), ("(?i)abc", [""]), ("abc(", [""]), (None, None), ("AÑOS", [""]), (r"\Qabc\E", [""]), ("[a&&[b]]xyz", [""])])
def test_pieces(pattern, expected):
    assert patterns.pieces(pattern) == expected


def test_thousand_patterns(spark):
    """Every pair of a full comparison; only patterns without a piece are tried on all texts."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdeiks") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    texts = [(i, " ".join(rng.choice(words) for _ in range(5))) for i in range(150)] + [(900, ""), (901, None), (902, "ab"), (903, "KIſS İskı " + words[0].upper())]
    pats = [(i, rng.choice([f"{a}.*{b}", f"(^| ){a}( |$)", f"{a}|{b}", f"({a}|{b}) .*{a}", f"{a[0]}[a-d]{b}", "kis|iski"]), b[:4] + "$") for i in range(1000) for a, b in [rng.sample(words, 2)]]
    pats += [(2000, None, "x"), (2001, "abc", None), (2002, "", "zzz")]
    t, p = spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(pats, "n long, inc string, exc string")
    found = patterns.regex_join(t, p, "text", "inc", "exc")
    every = t.join(F.broadcast(p), F.lit(True)).filter(matches(F.col("text"), F.col("inc")) & ~matches(F.col("text"), F.col("exc")))
    pairs = lambda df: sorted(map(tuple, df.select("id", "n").collect()))
    assert pairs(found) == pairs(every) and len(pairs(found)) > 1000 and "Cartesian" not in plan(found) and "NestedLoop" not in plan(found)
    python = {(i, n) for i, x in texts if x and x.isascii() for n, inc, exc in pats if inc is not None and exc is not None and re.search(inc, x, re.I) and not re.search(exc, x, re.I)}
    assert {(i, n) for i, n in pairs(found) if i not in (900, 903)} == python


def test_bitmaps(spark):
    """More values than a bitmap holds, nulls in keys and values, a key that holds a third of the rows."""
    rows = spark.range(120_000).select(F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 11 == 0, None).otherwise((F.col("id") % 5).cast("string")).alias("a"), (F.col("id") % 4).alias("b"), F.when(F.col("id") % 7 != 0, (F.col("id") % 70_001).cast("string")).alias("v"))
    ids = bitmaps.dense_ids(rows, "v")
    assert ids.count() == ids.select("id").distinct().count() == rows.select("v").distinct().count() - 1
    found = bitmaps.rolled_up(bitmaps.bitmaps(rows, ["a", "b"], "v", ids), {"AB": ["a", "b"], "A": ["a"], "B": ["b"], "ALL": []}, "n")
    truth = {(level, r["a"] if "a" in by else None, r["b"] if "b" in by else None): r.n for level, by in (("AB", ["a", "b"]), ("A", ["a"]), ("B", ["b"]), ("ALL", [])) for r in rows.groupBy(*by).agg(F.count_distinct("v").alias("n")).collect()}
    assert {(r.level, r.a, r.b): r.n for r in found.collect()} == truth
    none = rows.filter("false")
    assert bitmaps.rolled_up(bitmaps.bitmaps(none, ["a"], "v", bitmaps.dense_ids(none, "v")), {"A": ["a"], "ALL": []}, "n").count() == 0


def test_star(spark, tmp_path):
    """A month's rows are read from that month's files: the dates come from the calendar while the query runs."""
    rows = spark.range(3650).select(F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 120).cast("int")).alias("snapshot_date"), "id")
    semantic.write_star(Tables(prices=rows), str(tmp_path / "star"))
    found = semantic.read_star(spark, str(tmp_path / "star"), "prices", (F.col("year") == 2020) & (F.col("month") == 2))
    for file in (tmp_path / "star/prices").glob("snapshot_date=*/*.parquet"):
        if "=2020-02" not in str(file):
            file.write_bytes(b"not to be read")
    assert "dynamicpruning" in plan(found) and {"year", "month", "weekday"} <= set(found.columns)
    assert sorted(r.id for r in found.select("id").collect()) == sorted(r.id for r in rows.filter("month(snapshot_date) = 2").collect())


def test_jumps(spark, tmp_path):
    """Late days bring jumps, change them and take them back; what is too late is counted."""
    day = lambda n: dt.date(2024, 1, 1) + dt.timedelta(days=n)
    batches = [
        [("a", day(1), 10.0), ("a", day(2), 30.0), (None, day(1), 1.0), ("b", day(1), 5.0), ("b", day(3), 50.0), ("c", None, 1.0), ("c", day(1), None), ("c", day(2), -4.0)],
        [("a", day(1), 50.0), ("a", day(0), 2.0), (None, day(2), 9.0)],  # a: the median of day 1 is 30 now, no jump to day 2, a jump from day 0
        [("b", day(2), 5.0), ("a", day(40), 1.0)],
        [("a", day(1), 1.0), ("b", day(3), 1.0)],  # too late for a; b's day 3 has a median of 25.5
    ]
    shape = "s string, day date, value double"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
        jumps.publish(jumps.jumps(stream, ["s"], "day", "value", keep=30), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        now = sorted(((r.s or "", r.day, r.ratio) for r in jumps.current(spark, str(tmp_path / "out"), ["s"]).collect()))
        assert now == [
            [("a", day(2), 3.0)],
            [("", day(2), 9.0), ("a", day(1), 15.0)],
            [("", day(2), 9.0), ("a", day(1), 15.0), ("b", day(3), 10.0)],
            [("", day(2), 9.0), ("a", day(1), 15.0), ("b", day(3), 5.1)],
        ][k]
    assert spark.read.parquet(str(tmp_path / "out")).agg(F.sum("dropped")).first()[0] == 1


def test_jumps_equal_sql_to_the_last_bit(spark, tmp_path):
    """Medians of even counts at a ratio of exactly two, and days that come years late: as the windowed query has them."""
    import duckdb

    rng, day = random.Random(4), lambda n: dt.date(2020, 1, 1) + dt.timedelta(days=n)
    rows = [(str(s), day(n), v * n) for s in range(150) for x, y in [(rng.randint(1, 30000) / 100, rng.randint(1, 30000) / 100)] for n in (1, 2) for v in (x, y)]
    rows += [("late", day(n), v) for n, v in [(1500, 1.0), (3, 1.0), (4, 7.0)]]
    shape = "s string, day date, value double"
    for part in (rows[:-2], rows[-2:]):
        spark.createDataFrame(part, shape).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
        jumps.publish(jumps.jumps(stream, ["s"], "day", "value", high=1.9999, keep=None), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    found = {(r.s, r.day): r.ratio for r in jumps.current(spark, str(tmp_path / "out"), ["s"]).collect()}
    truth = duckdb.sql(f"WITH u AS (SELECT s, day, median(value) AS v FROM '{tmp_path}/in/*.parquet' GROUP BY ALL) SELECT a.s, a.day, a.v / b.v FROM u a JOIN u b ON a.s = b.s AND a.day = b.day + 1 WHERE a.v / b.v NOT BETWEEN 0.5 AND 1.9999").fetchall()
    assert found == {(s, d): r for s, d, r in truth} and len(truth) == 151
