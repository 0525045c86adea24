"""Backtests as one plan keyed by signal date: calendar, candidates, segments, net asset value, summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import divide
from ..operators.screening import screen

#: Months of a period.
PERIODS = {"monthly": 1, "quarterly": 3, "semiannual": 6, "annual": 12}


def rebalance_calendar(days: DataFrame, every: str = "quarterly", time: str = "trade_date") -> DataFrame:
    """(segment_id, rebalance_date, signal_date, next_date): the first day of each period, the trading day before it, and the next period's first day.

    The table of days has one row a trading day, and is put in order as one series.
    """
    series = Window.partitionBy(F.lit(0)).orderBy(time)
    d = days.select(time).distinct().withColumn("signal_date", F.lag(time).over(series)).withColumn("_p", F.floor((F.year(time) * 12 + F.month(time) - 1) / PERIODS[every]))
    first = d.withColumn("_before", F.lag("_p").over(series)).where("_before IS NULL OR _before <> _p")
    out = first.withColumn("segment_id", F.row_number().over(series)).withColumn("next", F.lead(time).over(series))
    return out.where("signal_date IS NOT NULL").select("segment_id", F.col(time).alias("rebalance_date"), "signal_date", F.col("next").alias("next_date"))


def candidates(values: DataFrame, factors: dict[str, bool], n: int, conditions: Sequence[dict] = (), match_all: bool = True) -> DataFrame:
    """The ``n`` securities of each signal date with the best mean percentile over all factors (name -> higher is better), equally weighted.

    With ``conditions`` (as of ``screening.screen``) only securities that meet all, or any, of them on the date are ranked.
    """
    if conditions:
        passed = screen(values.withColumnRenamed("signal_date", "trade_date"), conditions, match_all)
        values = values.join(passed.select(F.col("trade_date").alias("signal_date"), "security_id"), ["signal_date", "security_id"], "left_semi")
    rows = values.where(F.col("factor_id").isin(list(factors)) & F.col("factor_value").isNotNull())
    lower = [f for f, high in factors.items() if not high]
    turned = F.when(F.col("factor_id").isin(lower), -F.col("factor_value")).otherwise(F.col("factor_value")) if lower else F.col("factor_value")
    by = ["signal_date", "factor_id"]
    count = F.count("*").over(Window.partitionBy(*by))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_v"), "security_id"))
    scored = rows.withColumn("_v", turned).withColumn("_s", F.when(count == 1, 100.0).otherwise(divide(count - rank, count - 1) * 100))
    mean = scored.groupBy("signal_date", "security_id").agg(F.avg("_s").alias("score"), F.count("*").alias("_k")).where(F.col("_k") == len(factors))
    place = F.row_number().over(Window.partitionBy("signal_date").orderBy(F.desc("score"), "security_id"))
    kept = mean.withColumn("position", place).where(F.col("position") <= n)
    return kept.withColumn("weight", 1.0 / F.count("*").over(Window.partitionBy("signal_date"))).drop("_k")


def daily_returns(prices: DataFrame) -> DataFrame:
    w = Window.partitionBy("security_id").orderBy("trade_date")
    return prices.select("security_id", "trade_date", (divide("close", F.lag("close").over(w)) - 1).alias("ret"))


def segment_returns(positions: DataFrame, calendar: DataFrame, returns: DataFrame, cost: float = 0.001) -> DataFrame:
    """Equal-weight return of each day after a rebalance up to the next one; the cost falls on a segment's first day.

    Days get their segment by their date, so positions and returns meet by equality.
    """
    held = positions.join(F.broadcast(calendar), "signal_date").select("segment_id", "security_id")
    days = returns.select("trade_date").distinct()
    span = days.join(F.broadcast(calendar), (F.col("trade_date") > F.col("rebalance_date")) & (F.col("next_date").isNull() | (F.col("trade_date") <= F.col("next_date"))))
    daily = returns.join(F.broadcast(span.select("trade_date", "segment_id")), "trade_date").join(held, ["segment_id", "security_id"])
    mean = daily.groupBy("segment_id", "trade_date").agg(F.avg("ret").alias("r"), F.count("ret").alias("n_held"))
    full = span.select("segment_id", "trade_date").join(mean, ["segment_id", "trade_date"], "left")
    first = F.row_number().over(Window.partitionBy("segment_id").orderBy("trade_date")) == 1
    return full.select("segment_id", "trade_date", (F.coalesce("r", F.lit(0.0)) - F.when(first, cost).otherwise(0.0)).alias("daily_return"), F.coalesce("n_held", F.lit(0)).alias("n_held"))


def nav_curve(daily: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Net asset value from 1 and the drawdown from its running peak, for each portfolio of ``by``."""
    key = [F.col(c) for c in by or []] or [F.lit(0)]
    w = Window.partitionBy(*key).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    safe = F.greatest(F.col("daily_return"), F.lit(-0.999999))
    out = daily.withColumn("nav", F.exp(F.sum(F.log1p(safe)).over(w)))
    return out.withColumn("drawdown", F.col("nav") / F.greatest(F.max("nav").over(w), F.lit(1.0)) - 1)


def summary(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """CAGR, volatility, Sharpe and t statistics, worst drawdown, share of winning days among those that moved."""
    r: Column = F.col("daily_return")
    g = curve.groupBy(*(by or [])).agg(
        F.count("*").alias("n_days"), F.max_by("nav", "trade_date").alias("_nav"), F.datediff(F.max("trade_date"), F.min("trade_date")).alias("_days"), F.avg(r).alias("_m"),
        F.stddev_samp(r).alias("_s"), F.min("drawdown").alias("max_drawdown"), F.count_if(r > 0).alias("_win"), F.count_if(r != 0).alias("_moved"),
    )
    years = F.col("_days") / 365.25
    return g.select(
        *(by or []), "n_days", F.when(years > 0, F.pow("_nav", 1 / F.nullif(years, F.lit(0.0))) - 1).alias("cagr"), (F.col("_s") * F.sqrt(F.lit(252.0))).alias("volatility"),
        (divide("_m", "_s") * F.sqrt(F.lit(252.0))).alias("sharpe"), divide("_m", F.col("_s") / F.sqrt("n_days")).alias("t_stat"), "max_drawdown", divide("_win", "_moved").alias("win_rate"),
    )


def annual_returns(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    last = curve.groupBy(*(by or []), F.year("trade_date").alias("year")).agg(F.max_by("nav", "trade_date").alias("nav"))
    before = F.lag("nav", 1, 1.0).over(Window.partitionBy(*([F.col(c) for c in by or []] or [F.lit(0)])).orderBy("year"))
    return last.withColumn("annual_return", F.col("nav") / before - 1)


def information_coefficient(scores: DataFrame, forward: DataFrame, least: int = 5) -> DataFrame:
    """Correlation of a day's score ranks with the ranks of what followed."""
    both = scores.join(forward, ["trade_date", "security_id"]).where("value IS NOT NULL AND forward IS NOT NULL")
    day = Window.partitionBy("trade_date")
    ranked = both.select("trade_date", F.row_number().over(day.orderBy("value", "security_id")).cast("double").alias("a"), F.row_number().over(day.orderBy("forward", "security_id")).cast("double").alias("b"))
    return ranked.groupBy("trade_date").agg(F.count("*").alias("n"), F.corr("a", "b").alias("ic")).where(F.col("n") >= least)


def bucket_returns(scores: DataFrame, forward: DataFrame, buckets: int = 3) -> DataFrame:
    """Mean following return of each bucket of a day's scores (1 is the best)."""
    both = scores.join(forward, ["trade_date", "security_id"]).where("value IS NOT NULL AND forward IS NOT NULL")
    b = F.ntile(buckets).over(Window.partitionBy("trade_date").orderBy(F.desc("value"), "security_id"))
    return both.withColumn("bucket", b).groupBy("trade_date", "bucket").agg(F.count("*").alias("n"), F.avg("forward").alias("mean_return"))
