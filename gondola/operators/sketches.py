"""Approximate quantiles that roll up: KLL sketches of prices by day, product, banner and province, merged upward.

A sketch is made once from the prices and then only merged: to the four levels of dispersion, and over days to any window.
Its size is bounded by k, whatever it has seen. The rank of a quantile is off by at most `rank_error(k)` of the rows in 99
of 100 cases, twice that practically never.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gondola.operators.common import BANNER
from gondola.operators.dispersion import LEVELS

#: Of the sketch: larger is more exact, and larger.
K = 200


def rank_error(k: int = K) -> float:
    """The sketch's published error of a rank, as a share of the rows."""
    return 2.296 / k**0.9723


def daily(prices: DataFrame, k: int = K) -> DataFrame:
    """snapshot_date, gtin14, banner, provincia_codigo, sketch."""
    return prices.groupBy("snapshot_date", "gtin14", *BANNER, "provincia_codigo").agg(F.kll_sketch_agg_double(F.col("list_price").cast("double"), F.lit(k)).alias("sketch"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    return sketches.groupBy(*by).agg(F.kll_merge_agg_double("sketch").alias("sketch"))


def of_levels(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Merged for each level within `by`: dispersion_level, by, banner and province (null where the level has none), sketch."""
    parts = []
    finest = merged(sketches, [*by, *BANNER, "provincia_codigo"])  # the coarser levels start from the finest
    for level, keys in LEVELS.items():
        rows = finest if level == "BANNER_PROVINCE" else merged(finest, [*by, *keys])
        parts.append(rows.select(F.lit(level).alias("dispersion_level"), *by, *[(F.col(c) if c in keys else F.lit(None).cast("string")).alias(c) for c in (*BANNER, "provincia_codigo")], "sketch"))
    return reduce(DataFrame.unionByName, parts)


def quantile(share: float) -> F.Column:
    return F.kll_sketch_get_quantile_double("sketch", F.lit(share))


def rows() -> F.Column:
    return F.kll_sketch_get_n_double("sketch")
