"""Exact quantiles of groups of any size, by selection instead of a buffer for each group.

Equal values are counted first (with sums before the shuffle). A histogram of each group over value ranges that follow the
order of the values (RANGES to a doubling) tells which ranges hold the ranks in question; only their distinct values are
put in order and counted through, each range by itself. So a product that all stores sell, however many, is spread over
tasks by its values, sorts spill, and nothing is held for a group but a row for each range. Results equal
`stats.quantiles` to the bit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Ranges of values between a number and its double.
RANGES = 64


def _range(v: Column) -> Column:
    """A number that never falls as the value rises."""
    spread = lambda x: F.floor(F.log2(x.cast("double")) * RANGES)  # noqa: E731  of the least double over zero: about -1075 x RANGES
    far = 2000 * RANGES
    return F.when(v > 0, spread(v)).when(v == 0, F.lit(-far).cast("long")).otherwise(-2 * far - spread(-v))


def _between(spot: Column, low: Column, high: Column) -> Column:
    """The value at a spot between the values of the ranks around it."""
    below, above = F.floor(spot), F.ceil(spot)
    return F.when((below == above) | (low == high), low).otherwise((above - spot) * low + (spot - below) * high)


def quantiles_by(rows: DataFrame, keys: list[str], value: str, shares: list[float], times: str | None = None) -> DataFrame:
    """keys, n, least, most (of the values that are not null), quantiles (array, interpolated; those of decimals keep the
    type, cut towards zero). Groups without a value are left out; null keys are a group. times: a column that says how often a
    row's value counts."""
    of = rows.schema[value].dataType
    scale = 10**of.scale if isinstance(of, T.DecimalType) else None
    v = (F.col(value) * scale).cast("decimal(38,0)").cast("long") if scale else F.col(value).cast("double")
    counts = rows.select(*keys, v.alias("__v"), (F.col(times) if times else F.lit(1)).cast("long").alias("__n")).filter("__v IS NOT NULL").groupBy(*keys, "__v").agg(F.sum("__n").alias("__n")).withColumn("__b", _range(F.col("__v")))
    group = Window.partitionBy(*keys)
    upto = group.orderBy("__b").rowsBetween(Window.unboundedPreceding, 0)
    ranges = counts.groupBy(*keys, "__b").agg(F.sum("__n").alias("__m"), F.min("__v").alias("__low"), F.max("__v").alias("__high"))
    ranges = ranges.select(*keys, "__b", "__m", (F.sum("__m").over(upto) - F.col("__m")).alias("__before"), F.sum("__m").over(group).alias("__total"), F.min("__low").over(group).alias("__least"), F.max("__high").over(group).alias("__most"))
    spot = lambda share: (F.col("__total") - 1) * F.lit(share)
    ranks = [r for s in shares for r in (F.floor(spot(s)), F.ceil(spot(s)))]
    asked = reduce(Column.__or__, [(r >= F.col("__before")) & (r < F.col("__before") + F.col("__m")) for r in ranks])
    hit = ranges.filter(asked)
    theirs = hit.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__b").alias("__range"), "__before", "__total", "__least", "__most")
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)], F.col("__b") == F.col("__range"))
    order = Window.partitionBy(*keys, "__b").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    placed = counts.join(theirs, same).withColumn("__end", F.col("__before") + F.sum("__n").over(order))
    at = [F.max(F.when((r < F.col("__end")) & (r >= F.col("__end") - F.col("__n")), F.col("__v"))).alias(f"__r{i}") for i, r in enumerate(ranks)]
    found = placed.groupBy(*keys).agg(F.max("__total").alias("__total"), F.max("__least").alias("__least"), F.max("__most").alias("__most"), *at)

    between = lambda i, share: _between(spot(share), F.col(f"__r{2 * i}").cast("double"), F.col(f"__r{2 * i + 1}").cast("double"))
    back = (lambda x: (x.cast("long").cast("decimal(38,0)") / scale).cast(of)) if scale else (lambda x: x)
    return found.select(
        *keys, F.col("__total").alias("n"), back(F.col("__least")).alias("least"), back(F.col("__most")).alias("most"), F.array(*[back(between(i, s)) for i, s in enumerate(shares)]).alias("quantiles")
    )


def ranged(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """keys, range (null: of nulls), rows: what `asked` and `picked` read."""
    return rows.groupBy(*keys, _range(F.col(value).cast("double")).alias("__b")).agg(F.count(F.lit(1)).alias("__m"))


def _at_levels(df: DataFrame, keys: list[str], levels: dict[str, list[str]]) -> DataFrame:
    """Each row once for each level, whose other keys are null; the first keys stay as __f0 and so on."""
    out = df.select("*", *[F.col(k).alias(f"__f{i}") for i, k in enumerate(keys)], F.explode(F.array(*map(F.lit, range(len(levels))))).alias("__level"))
    return out.withColumns({k: F.when(F.col("__level").isin([i for i, own in enumerate(levels.values()) if k in own]), F.col(k)) for k in keys})


def _same(keys: list[str], left: str, right: str) -> Column:
    return reduce(Column.__and__, [F.col(f"{left}.{k}").eqNullSafe(F.col(f"{right}.{k}")) for k in keys])


def _spot(share: float) -> Column:
    return (F.col("__total") - 1) * F.lit(share)


def asked(counts: DataFrame, keys: list[str], levels: dict[str, list[str]], shares: list[float], guesses: DataFrame) -> DataFrame:
    """The ranges of each level that hold a rank in question or a guess, with what lies before them; of groups without values
    one row. guesses: __level (its number), keys and an array with a value for each share."""
    ranges = _at_levels(counts, keys, levels).groupBy("__level", *keys, "__b").agg(F.sum("__m").alias("__m"))
    group = Window.partitionBy("__level", *keys)
    upto = group.orderBy(F.asc_nulls_last("__b")).rowsBetween(Window.unboundedPreceding, 0)
    theirs = [_range(F.col("guesses")[i]).alias(f"__g{i}") for i in range(len(shares))]
    ranges = ranges.alias("a").join(guesses.alias("g"), _same(["__level", *keys], "a", "g"), "left").select("a.*", "guesses", *theirs)
    ranges = ranges.select("*", (F.sum("__m").over(upto) - F.col("__m")).alias("__before"), F.sum("__m").over(group).alias("n"), F.sum(F.when(F.col("__b").isNotNull(), F.col("__m")).otherwise(0)).over(group).alias("__total"), *[F.sum(F.when(F.col("__b") < F.col(f"__g{i}"), F.col("__m")).otherwise(0)).over(group).alias(f"__l{i}") for i in range(len(shares))])
    ranks = [r for s in shares for r in (F.floor(_spot(s)), F.ceil(_spot(s)))]
    holds = reduce(Column.__or__, [(r >= F.col("__before")) & (r < F.col("__before") + F.col("__m")) for r in ranks] + [F.col("__b") == F.col(f"__g{i}") for i in range(len(shares))])
    return ranges.filter((F.col("__b").isNotNull() & holds) | (F.col("__total") == 0))


def picked(rows: DataFrame, counts: DataFrame, hit: DataFrame, keys: list[str], levels: dict[str, list[str]], value: str, shares: list[float], few: bool) -> DataFrame:
    """__level, keys, n (rows), total (values), quantiles, guesses, below and upto (arrays: values less than a guess, or no
    greater). Of the rows only those in ranges that some level asks for are counted and shuffled, for all levels at once.
    few: counts are few enough to be broadcast."""
    firsts, by = [f"__f{i}" for i in range(len(keys))], ["__level", *keys, "__b"]
    wanted = _at_levels(counts, keys, levels).alias("a").join(hit.select(*by).alias("h"), _same(by, "a", "h"), "left_semi")
    wanted = wanted.groupBy(*firsts, "__b").agg(F.bit_or(F.expr("shiftleft(1, __level)")).alias("__in")).select(*[F.col(f).alias(k) for f, k in zip(firsts, keys)], "__b", "__in")
    v = F.col(value).cast("double")
    own = rows.select(*keys, v.alias("__v"), _range(v).alias("__b")).filter("__b IS NOT NULL").alias("a")
    own = own.join((F.broadcast(wanted) if few else wanted).alias("w"), _same([*keys, "__b"], "a", "w")).select("a.*", "w.__in")
    values = _at_levels(own.groupBy(*keys, "__b", "__in", "__v").agg(F.count(F.lit(1)).alias("__n")), keys, levels).filter("shiftleft(1, __level) & __in != 0")
    order = Window.partitionBy(*by).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    values = values.select(*by, "__v", "__n", F.sum("__n").over(order).alias("__end"))
    placed = hit.alias("h").join(values.alias("a"), _same(by, "h", "a"), "left").select("h.*", "a.__v", "a.__n", (F.col("__before") + F.col("a.__end")).alias("__end"))
    ranks = [r for s in shares for r in (F.floor(_spot(s)), F.ceil(_spot(s)))]
    at = [F.max(F.when((r < F.col("__end")) & (r >= F.col("__end") - F.col("__n")), F.col("__v"))).alias(f"__r{i}") for i, r in enumerate(ranks)]
    inside = lambda i, test: F.max(f"__l{i}") + F.sum(F.when((F.col("__b") == F.col(f"__g{i}")) & test(F.col("__v"), F.col("guesses")[i]), F.col("__n")).otherwise(0))
    found = placed.groupBy("__level", *keys).agg(
        F.max("n").alias("n"), F.max("__total").alias("__total"), F.max("guesses").alias("guesses"), *at,
        F.array(*[inside(i, lambda x, g: x < g) for i in range(len(shares))]).alias("below"), F.array(*[inside(i, lambda x, g: x <= g) for i in range(len(shares))]).alias("upto"),
    )
    return found.select("__level", *keys, "n", F.col("__total").alias("total"), F.array(*[_between(_spot(s), F.col(f"__r{2 * i}"), F.col(f"__r{2 * i + 1}")) for i, s in enumerate(shares)]).alias("quantiles"), "guesses", "below", "upto")


def medians_of(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """keys and the median of doubles (null where a group has none) for many groups of a few rows each: sorted rows are counted
    through and one or two of each group left, so nothing is gathered. Null keys are a group."""
    group = Window.partitionBy(*keys)
    placed = rows.select(*keys, value, F.row_number().over(group.orderBy(F.asc_nulls_last(value))).alias("__at"), F.count(value).over(group).alias("__n"))
    middle = placed.filter((F.col("__at") == F.floor((F.col("__n") + 1) / 2)) | (F.col("__at") == F.floor(F.col("__n") / 2) + 1))
    return middle.groupBy(*keys).agg((F.min(value) * 0.5 + F.max(value) * 0.5).alias(name))
