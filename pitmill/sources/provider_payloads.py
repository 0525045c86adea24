"""A provider's nested payloads: several arrays by period slot, and a history of releases, as observations and events.

A payload is one JSON text a symbol and snapshot. What does not parse, or has no
symbol, is reported and gives nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Period slots and the horizon they stand for. Fixed values.
HORIZONS = {"0q": "FQ1", "+1q": "FQ2", "0y": "FY1", "+1y": "FY2"}
#: Days of a trend by its field. Fixed values.
LOOKBACKS = {"current": 0, "7daysAgo": 7, "30daysAgo": 30, "60daysAgo": 60, "90daysAgo": 90}
_ESTIMATE = "array<struct<period: string, avg: double, low: double, high: double, numberOfAnalysts: int>>"
PAYLOAD = (
    f"symbol string, snapshot date, _bad string, data struct<earnings_estimate: {_ESTIMATE}, revenue_estimate: {_ESTIMATE}, "
    f"eps_trend: array<struct<period: string, {', '.join(f'`{c}`: double' for c in LOOKBACKS)}>>, "
    "eps_revisions: array<struct<period: string, upLast30days: double, downLast30days: double>>, "
    "earnings_history: array<struct<date: date, epsActual: double, epsEstimate: double, surprisePercent: double>>>"
)


def parsed(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """``payloads`` with the parsed struct ``p`` and is_bad."""
    p = F.from_json(payload, PAYLOAD, {"columnNameOfCorruptRecord": "_bad"})
    return payloads.withColumn("p", p).withColumn("is_bad", F.col("p._bad").isNotNull() | F.col("p.symbol").isNull())


def _measure(metric: str, statistic: str | None, lookback: int | None, value: Column) -> Column:
    return F.struct(F.lit(metric).alias("metric"), F.lit(statistic).cast("string").alias("statistic"), F.lit(lookback).cast("int").alias("lookback"), value.cast("double").alias("value"))


#: The metric of the row that stands for a payload which does not parse.
UNPARSED = "unparsed"
_SIDES = {"low": ("low", 0), "high": ("high", 0)}
#: By array: the metric, and by field the statistic and lookback.
MEASURES = {
    "eps_trend": ("eps", {field: ("average", days) for field, days in LOOKBACKS.items()}),
    "earnings_estimate": ("eps", _SIDES),
    "revenue_estimate": ("revenue", {"avg": ("average", 0)} | _SIDES),
    "eps_revisions": ("eps_revision", {"upLast30days": ("up", 30), "downLast30days": ("down", 30)}),
}


def observations(rows: DataFrame, unparsed: bool = False) -> DataFrame:
    """(symbol, snapshot, slot, horizon, metric, statistic, lookback, value, analysts) of the ``parsed`` payloads; of several entries of a slot the first counts.

    A payload is parsed once and each array searched once a slot; with ``unparsed``, one that does not parse
    gives a row of that metric and nothing else. (Filters stand above the generators, so that none repeats what is below.)
    """
    entry = lambda array, slot: F.get(F.filter(f"p.data.{array}", lambda e: e["period"] == slot), F.lit(0)).alias(array)
    slots = F.array(*(F.struct(F.lit(slot).alias("slot"), F.lit(horizon).alias("horizon"), *(entry(a, slot) for a in MEASURES)) for slot, horizon in HORIZONS.items()))
    good = ~F.col("is_bad")
    by_slot = rows.select(F.when(good, F.col("p.symbol")).alias("symbol"), F.when(good, F.col("p.snapshot")).alias("snapshot"), "is_bad", F.explode_outer(F.when(good, slots)).alias("s"))
    measures = [_measure(metric, *spec, F.col(f"s.{array}.{field}")) for array, (metric, fields) in MEASURES.items() for field, spec in fields.items()]
    if unparsed:
        measures.append(_measure(UNPARSED, None, None, F.lit(None)))
    long = by_slot.select("symbol", "snapshot", "is_bad", "s.slot", "s.horizon", F.col("s.earnings_estimate.numberOfAnalysts").alias("analysts"), F.inline(F.array(*measures)))
    kept = F.col("value").isNotNull()
    if unparsed:
        kept |= F.col("is_bad") & (F.col("metric") == UNPARSED)
    return long.where(kept).select("symbol", "snapshot", "slot", "horizon", "metric", "statistic", "lookback", "value", "analysts")


def releases(rows: DataFrame) -> DataFrame:
    """(symbol, event_date, reported_eps, estimated_eps, surprise_pct, available): a surprise of at most 1 in size is a ratio and becomes percent."""
    e = rows.where(~F.col("is_bad")).select("p.symbol", "p.snapshot", F.explode("p.data.earnings_history").alias("e")).where("e.date IS NOT NULL")
    s = F.col("e.surprisePercent")
    return e.select("symbol", F.col("e.date").alias("event_date"), F.col("e.epsActual").alias("reported_eps"), F.col("e.epsEstimate").alias("estimated_eps"), F.when(F.abs(s) <= 1, s * 100).otherwise(s).alias("surprise_pct"), F.col("snapshot").alias("available"))
