"""Consensus from analyst reports: what was valid on a day, per broker or analyst."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.semantics import divide
from .asof import asof_join


def validity(reports: DataFrame, by: list[str], days: int, time: str = "report_date", tie: str = "report_idx") -> DataFrame:
    """Add valid_to (exclusive): the next report of the same source, or ``days`` later; an older report never comes back."""
    w = Window.partitionBy(*by).orderBy(time, tie)
    newest = reports.withColumn("_r", F.row_number().over(Window.partitionBy(*by, time).orderBy(F.desc(tie)))).where("_r = 1").drop("_r")
    return newest.withColumn("valid_to", F.least(F.coalesce(F.lead(time).over(w), F.date_add(time, days)), F.date_add(time, days)))


def active(intervals: DataFrame, dates: DataFrame, by: list[str], time: str = "report_date") -> DataFrame:
    """Pairs of a date and the intervals that cover it. Both sides meet by month, so that a date sees few intervals."""
    month = lambda c: F.trunc(c, "month")
    spread = intervals.withColumn("_m", F.explode(F.sequence(month(time), month(F.date_sub("valid_to", 1)), F.expr("INTERVAL 1 MONTH"))))
    days = dates.select(*by, F.col("as_of"), month("as_of").alias("_m"))
    return days.join(spread, [*by, "_m"]).where((F.col("as_of") >= F.col(time)) & (F.col("as_of") < F.col("valid_to")))


def daily_consensus(reports: DataFrame, source: str = "broker", days: int = 181) -> DataFrame:
    """On each day with a report: mean, median, extremes and number of the sources' latest valid estimates."""
    found = active(validity(reports, ["security_id", source], days), reports.select("security_id", F.col("report_date").alias("as_of")).distinct(), ["security_id"])
    return found.groupBy("security_id", "as_of").agg(F.count("*").alias("n"), F.avg("estimate").alias("mean"), F.percentile("estimate", 0.5).alias("median"), F.min("estimate").alias("low"), F.max("estimate").alias("high"))


def boundary_consensus(reports: DataFrame, source: str = "analyst", days: int = 120) -> DataFrame:
    """The state at every change, also where it becomes empty."""
    spans = validity(reports, ["security_id", source], days)
    dates = spans.select("security_id", F.col("report_date").alias("as_of")).union(spans.select("security_id", "valid_to")).distinct()
    state = active(spans, dates, ["security_id"]).groupBy("security_id", "as_of").agg(F.count("*").alias("n"), F.avg("estimate").alias("mean"))
    return dates.join(state, ["security_id", "as_of"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def revisions(states: DataFrame, lookbacks: list[int], value: str = "mean", time: str = "as_of") -> DataFrame:
    """Percent change of a state against the one known so many days before: 100 (now - then) / max(|then|, 0.1)."""
    out = states
    for k in lookbacks:
        then = states.select("security_id", F.col(time).alias("_then"), F.col(value).alias("_prior"))
        out = asof_join(out.withColumn("_at", F.date_sub(time, k)).withColumnRenamed("_at", "_look"), then, ["security_id"], "_look", "_then").drop("_then", "_look")
        out = out.withColumn(f"revision_{k}d", divide((F.col(value) - F.col("_prior")) * 100, F.greatest(F.abs("_prior"), F.lit(0.1)))).drop("_prior")
    return out


def composite(reports: DataFrame, providers: list[str], dates: DataFrame, historical: Sequence[str] = ()) -> DataFrame:
    """Each date's value of the newest provider; of equally new ones the earlier in ``providers``.

    A ``historical`` provider counts only until, for the same security, the first of the others has reported.
    """
    if historical:
        past = F.col("broker").isin(list(historical))
        current_from = F.min(F.when(~past & F.col("broker").isin(providers), F.col("report_date"))).over(Window.partitionBy("security_id"))
        reports = reports.withColumn("_from", current_from).where(~past | F.col("_from").isNull() | (F.col("report_date") < F.col("_from"))).drop("_from")
    rank = F.coalesce(*(F.when(F.col("broker") == p, k) for k, p in enumerate(providers)))
    rows = reports.where(F.col("broker").isin(providers)).withColumn("_rank", rank)
    best = F.max(F.struct("report_date", -F.col("_rank"), "report_idx", "estimate", "broker"))
    newest = rows.groupBy("security_id", "report_date").agg(best.alias("b")).select("security_id", F.col("report_date").alias("source_date"), "b.estimate", "b.broker")
    return asof_join(dates, newest, ["security_id"], "as_of", "source_date")


def split_adjusted(prices: DataFrame, splits: DataFrame, value: str = "close") -> DataFrame:
    """Values in terms of the last day: divided by the product of the factors of later splits (security_id, split_date, factor)."""
    both = prices.join(splits.withColumnRenamed("split_date", "trade_date"), ["security_id", "trade_date"], "left")
    later = Window.partitionBy("security_id").orderBy(F.desc("trade_date")).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn(f"adj_{value}", F.col(value) / F.exp(F.coalesce(F.sum(F.log(F.coalesce("factor", F.lit(1.0)))).over(later), F.lit(0.0)))).drop("factor")


def horizons(periods: DataFrame, snapshot: Column, end: str = "period_end") -> DataFrame:
    """FY1, FY2, ... for period ends at or after the snapshot day, FY0, FY-1, ... for earlier ones."""
    future = F.col(end) >= snapshot
    up = F.row_number().over(Window.partitionBy("security_id", future).orderBy(end))
    down = F.row_number().over(Window.partitionBy("security_id", future).orderBy(F.desc(end)))
    return periods.withColumn("horizon", F.concat(F.lit("FY"), F.when(future, up).otherwise(1 - down).cast("string")))


def nearest_future(days: DataFrame, estimates: DataFrame, max_age: int = 180, time: str = "trade_date") -> DataFrame:
    """For each (security_id, day) the newest estimate, at most ``max_age`` days old, of the nearest target period that has not ended.

    ``estimates``: (security_id, metric_id, target_end, as_of_date, consensus_mean), one a
    day. An estimate holds until the next one of its period, its age or its period's
    end; days and these intervals meet by month.
    """
    w = Window.partitionBy("security_id", "metric_id", "target_end").orderBy("as_of_date")
    ends = [F.date_add("as_of_date", max_age + 1), F.date_add("target_end", 1), F.lead("as_of_date").over(w)]
    spans = estimates.withColumn("valid_to", F.least(*ends)).where("valid_to > as_of_date")
    found = active(spans, days.select("security_id", F.col(time).alias("as_of")).distinct(), ["security_id"], "as_of_date")
    best = found.groupBy("security_id", F.col("as_of").alias(time)).agg(F.min(F.struct("target_end", "consensus_mean")).alias("b"))
    return days.join(best, ["security_id", time], "left").select("security_id", time, F.col("b.target_end").alias("target_end"), F.col("b.consensus_mean").alias("estimate"))


def estimate_history(estimates: DataFrame, metric: str | None = None, first: str | None = None, last: str | None = None, target_from: str | None = None) -> DataFrame:
    """Estimates of a metric that became known between two days, for target periods that end on a day or later."""
    out = estimates
    for column, test, value in (("metric_id", "__eq__", metric), ("as_of_date", "__ge__", first), ("as_of_date", "__le__", last), ("target_end", "__ge__", target_from)):
        if value is not None:
            out = out.where(getattr(F.col(column), test)(F.lit(value)))
    return out


def lookback_revisions(estimates: DataFrame, by: list[str], time: str, value: str, lookbacks: list[int]) -> DataFrame:
    """rev_k: percent change against the newest estimate with the same key at least k days older; acceleration: the last 30 days against half of the 60 before."""
    out = estimates
    change = lambda now, then: divide((F.col(now) - F.col(then)) * 100, F.greatest(F.abs(then), F.lit(0.1)))
    for k in lookbacks:
        then = estimates.select(*by, F.col(time).alias("_then"), F.col(value).alias(f"_b{k}"))
        out = asof_join(out.withColumn("_look", F.date_sub(time, k)), then, by, "_look", "_then").drop("_look", "_then")
    out = out.withColumns({f"rev_{k}": change(value, f"_b{k}") for k in lookbacks})
    if {30, 90} <= set(lookbacks):
        out = out.withColumn("acceleration", F.col("rev_30") - change("_b30", "_b90") / 2)
    return out.drop(*(f"_b{k}" for k in lookbacks))


def strict_targets(days: DataFrame, events: DataFrame, providers: list[str], least: int = 3, time: str = "factor_date") -> DataFrame:
    """On each day the target of the first of ``providers`` whose newest event so far is positive and of ``least`` analysts."""
    rank = F.posexplode(F.array(*map(F.lit, providers)))
    asked = days.select("security_id", time, rank.alias("_rank", "provider"))
    newest = asof_join(asked, events.where(F.col("provider").isin(providers)).withColumnRenamed(time, "_known"), ["security_id", "provider"], time, "_known")
    good = newest.where(F.col("_known").isNotNull() & (F.col("target") > 0) & (F.col("analyst_count") >= least))
    best = good.groupBy("security_id", time).agg(F.min(F.struct("_rank", "provider", "target")).alias("b"))
    return days.join(best, ["security_id", time], "left").select("security_id", time, F.col("b.provider").alias("provider"), F.col("b.target").alias("target"))


def implied_surprise(eps: str, shares: str, net_income: str, operating_income: str) -> Column:
    """Percent by which the operating income that the consensus EPS implies, at today's relation to net income, exceeds today's."""
    implied = divide(F.col(operating_income) * F.col(eps) * F.col(shares), F.col(net_income))
    good = (F.col(eps) > 0) & (F.col(shares) > 0) & (F.col(net_income) > 0) & (F.col(operating_income) > 0)
    return F.when(good, divide(implied - F.col(operating_income), F.abs(operating_income)) * 100)
