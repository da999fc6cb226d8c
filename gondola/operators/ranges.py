"""Range join: points with the ranges that hold them, by equality on aligned blocks instead of a comparison of all.

The whole numbers are cut into blocks of fan**level, for each level. A range is the sum of a few such blocks that don't
overlap, at most 2 * (fan - 1) a level; a point lies in one block of each level. So a point and a range that holds it meet
in exactly one block: the join is an equality, its rows are the result's, and nothing is filtered after it. Points take part
once for each key and value, whatever their rows, and only in the levels up to the longest range's. Statistics don't see how
many blocks a range has, so the blocks are never broadcast.

Defined cases: ends are inclusive, a null end is open, a range whose low end is above its high one holds nothing; null
points and null keys match nothing; repeated points and ranges give a row for each pair.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FAN = 16
#: Levels below the top: 16**14 is beyond every date, and every microsecond of two thousand years.
LEVELS = 14
#: Of the join: fewer blocks a range, for a few levels more.
JOIN_FAN = 4


def days(date: Column) -> Column:
    """A date as a whole number."""
    return F.unix_date(date).cast("long")


def _floor(value: Column, size: Column) -> Column:
    """Of whole numbers that aren't negative."""
    return F.call_function("div", value, size)


def _run(a: Column, z: Column) -> Column:
    """a, a + 1 ... z - 1, empty where z <= a."""
    return F.when(a < z, F.sequence(a, F.greatest(z - 1, a))).otherwise(F.array().cast("array<bigint>"))


def blocks(low: Column, end: Column, fan: int = FAN, levels: int = LEVELS) -> Column:
    """The blocks of low <= x < end, as an array of (level, block), up to this level. Both are whole and not negative."""
    sizes = F.array(*[F.lit(fan**k).cast("long") for k in range(levels + 2)])

    def of_level(k: Column) -> Column:
        size, above = F.get(sizes, k), F.get(sizes, k + 1)
        first, last = _floor(low + size - 1, size), _floor(end, size)
        left, right = _floor(low + above - 1, above) * fan, _floor(end, above) * fan  # what the levels above take
        inner = (left < right) & (k < levels)
        tail = F.when(inner, _run(right, last)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(F.concat(_run(first, F.when(inner, left).otherwise(last)), tail), lambda b: F.struct(k.alias("level"), b.alias("block")))

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(levels)), of_level))


def range_join(points: DataFrame, ranges: DataFrame, keys: list[str], point: str, low: str, high: str) -> DataFrame:
    """points and ranges of equal keys with low <= point <= high: all columns of both, keys once. The three are of type long.

    Columns of both sides must differ, keys aside. Shuffles: the points' distinct values, the blocks, and the points once."""
    taken = {*points.columns, *ranges.columns}
    at, level, block, packed = (next(n for n in (f"{name}{'_' * i}" for i in range(len(taken) + 1)) if n not in taken) for name in ("at", "level", "block", "packed"))
    span = points.agg(F.min(point).alias("a"), F.max(point).alias("z")).first()  # two values
    if span.a is None:
        return points.limit(0).join(ranges.limit(0), keys)
    # open ends and ends beyond all points come to the points' ends; counted from the first point
    start = F.greatest(F.coalesce(F.col(low), F.lit(span.a)), F.lit(span.a)) - F.lit(span.a)
    end = F.least(F.coalesce(F.col(high), F.lit(span.z)), F.lit(span.z)) - F.lit(span.a) + 1
    longest = ranges.agg(F.max(end - start)).first()[0]  # a value
    if longest is None or longest <= 0:
        return points.limit(0).join(ranges.limit(0), keys)
    top = 0
    while JOIN_FAN ** (top + 1) <= longest:
        top += 1
    held = ranges.withColumn(packed, F.explode(F.when(start < end, blocks(start, end, JOIN_FAN, top))))
    held = held.withColumns({level: F.col(f"{packed}.level"), block: F.col(f"{packed}.block")}).drop(packed)
    values = points.filter(F.col(point).isNotNull()).select(*keys, F.col(point).alias(at)).distinct()
    spread = values.withColumn(packed, F.explode(F.array(*[F.struct(F.lit(k).alias("level"), _floor(F.col(at) - F.lit(span.a), F.lit(JOIN_FAN**k).cast("long")).alias("block")) for k in range(top + 1)])))
    spread = spread.select(*keys, at, F.col(f"{packed}.level").alias(level), F.col(f"{packed}.block").alias(block))
    pairs = spread.join(held.hint("merge"), [*keys, level, block]).drop(level, block)
    return points.withColumn(at, F.col(point)).join(pairs.hint("merge"), [*keys, at]).drop(at)
