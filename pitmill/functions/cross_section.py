"""Statistics within a day's peer group. Every window has a key, so no step gathers all rows in one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .semantics import divide


def quantile_exact(values: DataFrame, by: list[str], value: str, levels: dict[str, float]) -> DataFrame:
    """The element at index floor(p n) of a group's sorted values, without interpolation; one column a level."""
    order = Window.partitionBy(*by).orderBy(value)
    ranked = values.where(F.col(value).isNotNull()).select(*by, value, F.row_number().over(order).alias("_rank"), F.count("*").over(Window.partitionBy(*by)).alias("_n"))
    place = lambda q: F.least(F.col("_n"), F.floor(F.col("_n") * q) + 1)
    return ranked.groupBy(*by).agg(*(F.max(F.when(F.col("_rank") == place(q), F.col(value))).alias(name) for name, q in levels.items()))


def winsorize(values: DataFrame, by: list[str], value: str, low: float, high: float, name: str) -> DataFrame:
    """``value`` kept between its group's exact quantiles."""
    bounds = quantile_exact(values, by, value, {"_low": low, "_high": high})
    out = values.join(bounds, by, "left")
    return out.withColumn(name, F.when(F.col(value).isNotNull(), F.greatest("_low", F.least("_high", value)))).drop("_low", "_high")


def z_score(value: Column, by: list[str], sample: bool = False, least: int = 2) -> Column:
    """NULL below ``least`` values or without spread."""
    w = Window.partitionBy(*by)
    spread = (F.stddev_samp if sample else F.stddev_pop)(value).over(w)
    return F.when(F.count(value).over(w) >= least, divide(value - F.avg(value).over(w), F.nullif(spread, F.lit(0.0))))


def shrunk_z_score(value: Column, group: list[str], market: list[str], strength: float, least: int = 5) -> Column:
    """The group's z-score, drawn to the market's by n / (n + strength); the market's alone in small groups."""
    n = F.count(value).over(Window.partitionBy(*group)).cast("double")
    own, all_ = z_score(value, group), z_score(value, market)
    share = n / (n + strength)
    return F.when((n >= least) & own.isNotNull(), share * own + (1 - share) * all_).otherwise(all_)


def neutralized(value: Column, by: list[str]) -> Column:
    return value - F.avg(value).over(Window.partitionBy(*by))


def ordinal(value: Column, by: list[str], tie: str, descending: bool = True) -> Column:
    return F.row_number().over(Window.partitionBy(*by).orderBy(value.desc_nulls_last() if descending else value.asc_nulls_last(), tie))


def percent_rank(value: Column, by: list[str], tie: str, descending: bool = False) -> Column:
    n = F.count("*").over(Window.partitionBy(*by))
    return F.when(n == 1, F.lit(1.0)).otherwise(divide(ordinal(value, by, tie, descending) - 1, n - 1))


def average_rank(value: Column, by: list[str], descending: bool = False) -> Column:
    """Ties share the mean of their places."""
    w = Window.partitionBy(*by).orderBy(value.desc_nulls_last() if descending else value.asc_nulls_last())
    ties = F.count("*").over(Window.partitionBy(*by, value))
    return F.rank().over(w) + (ties - 1) / 2


def percentile_of_rank(value: Column, rank: Column, ties: Column, n: Column) -> Column:
    """0 to 100 by the mean of the places that equal values share, from the first of them; 100 in a group of one."""
    score = divide(rank + (ties - 1) / 2 - 1, n - 1) * 100
    return F.when(value.isNull(), None).when(n == 1, F.lit(100.0)).otherwise(score)


def percentile_score(value: Column, by: list[str], lower_better: bool = False) -> Column:
    """0 to 100 by average rank; 100 in a group of one."""
    n = F.count("*").over(Window.partitionBy(*by))
    score = divide(average_rank(value, by, lower_better) - 1, n - 1) * 100
    return F.when(value.isNull(), None).when(n == 1, F.lit(100.0)).otherwise(score)


def robust_z(value: Column, median: Column, mad: Column, limit: float = 3.0) -> Column:
    """0.6745 (x - median) / MAD within limits; 0 without spread."""
    z = F.when(mad == 0, F.lit(0.0)).otherwise(divide(value - median, mad) * 0.6745)
    return F.when(value.isNotNull(), F.greatest(F.lit(-limit), F.least(F.lit(limit), z)))
