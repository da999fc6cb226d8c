"""Day-over-day jumps of series on a stream, in whatever order the observations arrive.

The state of a series is, for each day, its values and how often each was seen: as large as the days' distinct values.
Series are dealt to a fixed number of groups by their hash, and a group's state is one set of sorted arrays, so that Python
is called by group, not by series, and a batch costs a few array operations for each group it touches. A batch tests only
the days it touches and their successors. Where a jump appears, changes or is taken back, a row goes out with the batch's
number; `current` reads what holds in the end. Days more than `keep` before a series' latest one leave the state, and
observations of such days are late beyond use: they are counted in `dropped`, never silently lost. With a keep of None every
day stays, and nothing is late.

Defined cases: null keys are series, null days and values that are null or not positive take no part; an observation
that comes twice counts twice; a gap in the days suppresses the test; an empty stream gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Days kept in a series' state.
KEEP = 400

#: Groups of series. A checkpoint's states depend on it.
GROUPS = 1024

#: Observations of a group that are gathered, at least, before they are counted.
GATHERED = 1 << 18

#: A code is a series' number and a day; days are numbers of 32 bits with sign.
_DAYS, _ZERO = 1 << 32, 1 << 31

#: Keys travel as text; of these types the text of a cast can't be read back.
_TEXT = {"binary": F.base64, "timestamp": F.unix_micros, "float": lambda c: F.when(c == 0, 0.0).otherwise(c), "double": lambda c: F.when(c == 0, 0.0).otherwise(c)}
_BACK = {"binary": F.unbase64, "timestamp": lambda c: F.timestamp_micros(c.cast("long"))}


def _counted(codes: np.ndarray, values: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by code and value, equal ones added up."""
    order = np.lexsort((values, codes))
    codes, values, times = codes[order], values[order], times[order]
    new = np.flatnonzero(np.concatenate(([True], (codes[1:] != codes[:-1]) | (values[1:] != values[:-1])))[: len(codes)])
    return codes[new], values[new], np.add.reduceat(times, new) if len(new) else times


def _medians(codes: np.ndarray, values: np.ndarray, times: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes and their medians. Exact: halves of the two middle ones are added, as SQL's median does, to the last bit."""
    days, first = np.unique(codes, return_index=True)
    upto = np.cumsum(times)
    before = upto[first] - times[first]
    n = np.diff(np.append(before, upto[-1:]))
    low, high = (values[np.searchsorted(upto, before + place, "right")] for place in ((n - 1) // 2, n // 2))
    return days, low * 0.5 + high * 0.5


def _step(low: float, high: float, keep: int | None):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        whole, real = np.empty(0, np.int64), np.empty(0)
        names, codes, values, times, shown, ratios = pickle.loads(state.get[0]) if state.exists else ([], whole, real, whole, whole, real)
        place = {name: k for k, name in enumerate(names)}
        times, touched, late, new = times.astype(np.int64), [], [], []
        latest = np.full(len(names), -_ZERO)
        if keep is not None:
            np.maximum.at(latest, codes // _DAYS, codes % _DAYS - _ZERO)

        def count() -> None:
            nonlocal codes, values, times
            touched.append(np.unique(np.concatenate([c for c, _ in new])))
            codes, values, times = _counted(np.concatenate([codes, *[c for c, _ in new]]), np.concatenate([values, *[v for _, v in new]]), np.concatenate([times, np.ones(sum(len(c) for c, _ in new), np.int64)]))
            new.clear()

        for frame in frames:
            own, found = pd.factorize(frame["series"])
            series = np.array([place.setdefault(name, len(place)) for name in found], np.int64)[own]
            day, value = frame["day"].to_numpy(np.int64), frame["value"].to_numpy(np.float64)
            if keep is not None:
                latest = np.append(latest, np.full(len(place) - len(latest), -_ZERO))
                order = np.argsort(series, kind="stable")  # in order of arrival within a series
                upto = np.empty_like(day)
                upto[order] = np.maximum.accumulate((series * _DAYS + day + _ZERO)[order]) % _DAYS - _ZERO
                good = day >= np.maximum(upto, latest[series]) - keep
                late.append(series[~good])
                series, day, value = series[good], day[good], value[good]
                np.maximum.at(latest, series, day)
            new.append((series * _DAYS + day + _ZERO, value))
            if sum(len(c) for c, _ in new) >= max(GATHERED, len(codes)):
                count()
        if new:
            count()
        names = list(place)
        out = []
        if len(codes):
            days, medians = _medians(codes, values, times)
            follows = np.concatenate(([False], days[1:] == days[:-1] + 1))
            with np.errstate(all="ignore"):
                jump = medians / np.concatenate(([1.0], medians[:-1]))
            up = follows & ~((jump >= low) & (jump <= high))
            was, had = np.isin(days, shown), np.zeros(len(days))
            had[was] = ratios
            at = np.concatenate([whole, *touched])
            tested = np.isin(days, np.concatenate([at, at + 1]))
            same = (up == was) & (~up | (jump == had) | (np.isnan(jump) & np.isnan(had)))
            k = np.flatnonzero(tested & ~same)
            out.append((days[k] // _DAYS, days[k] % _DAYS - _ZERO, np.where(up, jump, np.nan)[k], up[k], np.zeros(len(k), np.int64)))
            up, jump = np.where(tested, up, was), np.where(tested, jump, had)
            if keep is not None:
                stays = lambda c: c % _DAYS - _ZERO >= latest[c // _DAYS] - keep
                up &= stays(days)
                own = stays(codes)
                codes, values, times = codes[own], values[own], times[own]
            shown, ratios = days[up], jump[up]
        if late:
            series, n = np.unique(np.concatenate(late), return_counts=True)
            out.append((series, np.zeros(len(n), np.int64), np.full(len(n), np.nan), np.zeros(len(n), bool), n))
        state.update((pickle.dumps((names, codes, values, times.astype(np.min_scalar_type(times.max(initial=1))), shown, ratios), protocol=5),))
        series, day, ratio, held, dropped = (np.concatenate(c) for c in zip(*out)) if out else (whole,) * 5
        if len(series):
            yield pd.DataFrame({"series": np.array(names, object)[series], "day": day.astype(np.int32), "ratio": ratio, "held": held.astype(bool), "dropped": dropped.astype(np.int64)})

    return run


def jumps(observed: DataFrame, series: list[str], day: str, value: str, low: float = 0.5, high: float = 2.0, keep: int | None = KEEP) -> DataFrame:
    """A stream of changes: series, day, ratio (null: taken back), dropped. observed is a stream."""
    kinds = dict(observed.dtypes)
    same = lambda c: c
    text = F.to_json(F.array(*[_TEXT.get(kinds[c], same)(F.col(c)).cast("string") for c in series]))
    rows = observed.filter(F.col(day).isNotNull() & (F.col(value) > 0)).select(text.alias("series"), F.unix_date(F.col(day)).alias("day"), F.col(value).cast("double").alias("value"))
    rows = rows.withColumn("dealt", F.pmod(F.xxhash64("series"), F.lit(GROUPS)).cast("int"))
    changed = rows.groupBy("dealt").applyInPandasWithState(_step(low, high, keep), "series string, day int, ratio double, held boolean, dropped long", "held binary", "update", GroupStateTimeout.NoTimeout)
    names = F.from_json("series", "array<string>")
    keys = [_BACK.get(kinds[c], same)(names[i]).cast(kinds[c]).alias(c) for i, c in enumerate(series)]
    ratio = F.when(F.col("held"), F.coalesce("ratio", F.lit(float("nan"))))  # Arrow has no numbers that are none
    return changed.select(*keys, F.when(F.col("dropped") == 0, F.date_from_unix_date("day")).alias("day"), ratio.alias("ratio"), "dropped")


def publish(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each batch is a folder of its own, which a repeated batch overwrites."""

    def take(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return changes.writeStream.outputMode("update").foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, series: list[str]) -> DataFrame:
    """The jumps that hold after all batches: the last change of each series and day."""
    rows = spark.read.parquet(path).filter("day IS NOT NULL")
    place = Window.partitionBy(*series, "day").orderBy(F.desc("batch"))
    return rows.withColumn("place", F.row_number().over(place)).filter("place = 1 AND ratio IS NOT NULL").select(*series, "day", "ratio")
