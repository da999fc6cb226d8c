"""Jumps on a stream: a state holds many series, and does what one for each series did."""

import datetime as dt
import random
from statistics import median

import pandas as pd
from pyspark.sql import functions as F

from gondola.streaming import jumps


class State:
    exists, get = False, None

    def update(self, value):
        self.exists, self.get = True, value


def test_series_share_states(spark, tmp_path):
    """The states are as many as the groups, however many series there are; keys of any kind come back as they were."""
    shape = "n long, s string, b binary, t timestamp, x double, day date, value double"
    rows = spark.range(6000).select(
        F.when(F.col("id") % 3000 > 0, F.col("id") % 3000 + (1 << 60)).alias("n"), F.when(F.col("id") % 3 > 0, F.concat(F.lit('",[\\ \n'), F.col("id") % 3)).alias("s"),
        F.unhex(F.lit("FF00")).alias("b"), F.timestamp_micros(F.col("id") % 3000 + 1).alias("t"), F.when(F.col("id") % 2 == 0, F.lit(float("nan"))).otherwise(0.0).alias("x"),
        F.date_add(F.lit("2024-01-01").cast("date"), F.floor(F.col("id") / 3000).cast("int")).alias("day"), F.when(F.col("id") < 3000, 1.0).otherwise(3.0).alias("value"),
    )
    keys = ["n", "s", "b", "t", "x"]
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(shape).parquet(str(tmp_path / "in"))
    query = jumps.publish(jumps.jumps(stream, keys, "day", "value"), str(tmp_path / "out"), str(tmp_path / "state"))
    query.awaitTermination()
    assert 0 < query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 1024
    found = jumps.current(spark, str(tmp_path / "out"), keys)
    same = rows.filter("value = 3").select(*keys, "day", F.lit(3.0).alias("ratio"))
    assert found.count() == 3000 and found.exceptAll(same).isEmpty() and dict(found.dtypes)["t"] == "timestamp"


def _plain(low, high, keep):
    """A series by itself, row by row."""
    held = {}

    def batch(rows):
        out, touched, dropped = [], {}, {}
        for s, day, value in rows:
            days, _ = held.setdefault(s, ({}, {}))
            if keep is not None and days and day < max(days) - keep:
                dropped[s] = dropped.get(s, 0) + 1
                continue
            days.setdefault(day, []).append(value)
            touched.setdefault(s, set()).update({day, day + 1})
        for s, (days, shown) in held.items():
            for day in touched.get(s, ()):
                ratio = median(days[day]) / median(days[day - 1]) if day in days and day - 1 in days else None
                jump = ratio if ratio is not None and not low <= ratio <= high else None
                if jump != shown.get(day):
                    out.append((s, day, jump))
                shown[day] = jump
            first = max(days) - keep if days and keep is not None else -10**6
            held[s] = ({d: v for d, v in days.items() if d >= first}, {d: v for d, v in shown.items() if d >= first})
        return sorted(out, key=str), dropped

    return batch


def test_groups_equal_series_by_themselves(monkeypatch):
    """Random batches in any order, days that leave and come too late, counted in several portions."""
    monkeypatch.setattr(jumps, "GATHERED", 5)
    rng, late, changes = random.Random(7), 0, 0
    for keep in (None, 0, 4):
        step, plain, state = jumps._step(0.5, 2.0, keep), _plain(0.5, 2.0, keep), State()
        for k in range(40):
            rows = [(f"s{rng.randint(0, 6)}", k // 4 + rng.randint(-6, 3), 2.0 ** rng.randint(0, 3)) for _ in range(rng.randint(0, 40))]
            frames = [pd.DataFrame(rows[i : i + 7], columns=["series", "day", "value"]) for i in range(0, len(rows), 7)]
            got = next(step((0,), iter(frames), state), pd.DataFrame(columns=["series", "day", "ratio", "held", "dropped"]))
            out, dropped = plain(rows)
            assert sorted([(s, int(d), float(r) if h else None) for s, d, r, h, n in got.itertuples(index=False) if not n], key=str) == out
            assert {s: n for s, d, r, h, n in got.itertuples(index=False) if n} == dropped
            late, changes = late + len(dropped), changes + len(out)
    assert late > 20 and changes > 200


def test_infinite_values_keep_their_jumps(spark, tmp_path):
    """Infinity after infinity has a ratio that is no number: outside the bounds, as SQL has it, and not taken back."""
    day = lambda n: dt.date(2024, 1, n)
    spark.createDataFrame([("a", day(1), float("inf")), ("a", day(2), float("inf")), ("b", day(1), 1.0), ("b", day(2), float("inf"))], "s string, day date, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("s string, day date, value double").parquet(str(tmp_path / "in"))
    jumps.publish(jumps.jumps(stream, ["s"], "day", "value"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted((r.s, str(r.ratio)) for r in jumps.current(spark, str(tmp_path / "out"), ["s"]).collect()) == [("a", "nan"), ("b", "inf")]
