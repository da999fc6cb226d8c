"""Aggregates: exact quantiles, geometric means, safe ratios, coverage statuses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PUBLISHABLE, DIRECTIONAL, SUPPRESSED, INVALID_GEOGRAPHY = "PUBLISHABLE", "DIRECTIONAL", "SUPPRESSED", "INVALID_GEOGRAPHY"


def kind(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def quantiles(value: Column, shares: list[float], of: T.DataType | None = None, where: Column | None = None, times: Column | None = None) -> Column:
    """Array of exact interpolated quantiles. Those of decimals keep the decimal type, cut towards zero.

    times: how often a row's value counts."""
    value = value if where is None else F.when(where, value)
    times = F.lit(1) if times is None else times
    if not isinstance(of, T.DecimalType):
        return F.percentile(value.cast("double"), F.array(*map(F.lit, shares)), times)
    scale = 10**of.scale
    whole = F.percentile((value * scale).cast("decimal(38,0)").cast("long"), F.array(*map(F.lit, shares)), times)
    return F.transform(whole, lambda x: (x.cast("long").cast("decimal(38,0)") / scale).cast(of))


def median(value: Column, of: T.DataType | None = None, where: Column | None = None) -> Column:
    return quantiles(value, [0.5], of, where)[0]


def small_median(column: str) -> Column:
    """Median of doubles as an aggregate for many groups of a few rows each: sorted lists cost less than maps of counts."""
    own = F.sort_array(F.collect_list(column))
    low, high = (F.get(own, F.floor(place / 2).cast("int")) for place in (F.size(own) - 1, F.size(own)))
    return F.when(F.size(own) > 0, low * 0.5 + high * 0.5)


def geometric_mean(value: Column) -> Column:
    return F.exp(F.avg(F.ln(value.cast("double"))))


def ratio(part: Column, whole: Column) -> Column:
    """As double; null where the whole is 0 or null."""
    return part.cast("double") / F.nullif(whole.cast("double"), F.lit(0.0))


def outside(value: Column, low: float, high: float) -> Column:
    return (value < low) | (value > high)


def rows(where: Column | None = None) -> Column:
    return F.count(F.lit(1)) if where is None else F.count_if(where)


def banner_key(*columns: str) -> Column:
    return F.concat_ws("|", *columns)


def valid_geography(province: str | Column, prefix: str) -> Column:
    column = F.col(province) if isinstance(province, str) else province
    return F.coalesce(column.startswith(prefix), F.lit(False))


def status(publishable: Column, directional: Column, invalid: Column | None = None) -> Column:
    """Publication status; invalid geography is tested first."""
    out = F.when(invalid, INVALID_GEOGRAPHY).when(publishable, PUBLISHABLE) if invalid is not None else F.when(publishable, PUBLISHABLE)
    return out.when(directional, DIRECTIONAL).otherwise(SUPPRESSED)
