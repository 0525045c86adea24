"""Nested provider payloads, which the orders and all their lines stand for."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import provider_payloads as pp
from ..sources.views import read


def _payloads(spark, d):
    """An order is a payload: its lines in order, each an entry of the slot of its number and a release; every 40th text is cut off."""
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", F.to_date("l_shipdate").alias("day"))
    slot = lambda e: F.element_at(F.array(*map(F.lit, pp.HORIZONS)), ((e["l_linenumber"] - 1) % 4 + 1).cast("int")).alias("period")
    estimate = lambda e: F.struct(slot(e), e["l_extendedprice"].alias("avg"), F.when(e["l_discount"] > 0, e["l_quantity"] * 0.5).alias("low"), (e["l_quantity"] * 2).alias("high"), e["l_linenumber"].cast("int").alias("numberOfAnalysts"))
    trend = lambda e: F.struct(slot(e), *((e["l_quantity"] + k if k != 60 else F.lit(None).cast("double")).alias(name) for name, k in pp.LOOKBACKS.items()))
    revisions = lambda e: F.struct(slot(e), (e["l_discount"] * 100).alias("upLast30days"), (e["l_tax"] * 100).alias("downLast30days"))
    history = lambda e: F.struct(e["day"].alias("date"), e["l_quantity"].alias("epsActual"), (e["l_quantity"] - 1).alias("epsEstimate"), F.when(e["l_linenumber"] % 2 == 0, e["l_discount"]).otherwise(e["l_quantity"]).alias("surprisePercent"))
    # a line's own columns are collected; what the payload says of them is made of the order's list
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_discount", "l_quantity", "l_tax", "day")
    g = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(line)).alias("x"))
    arrays = {"earnings_estimate": estimate, "revenue_estimate": estimate, "eps_trend": trend, "eps_revisions": revisions, "earnings_history": history}
    data = F.struct(*(F.transform("x", of).alias(name) for name, of in arrays.items()))
    text = F.to_json(F.struct(F.concat(F.lit("S"), (F.col("l_orderkey") % 50).cast("string")).alias("symbol"), F.lit("2000-01-01").alias("snapshot"), data.alias("data")))
    return pp.parsed(g.select("l_orderkey", F.when(F.col("l_orderkey") % 40 == 0, F.substring(text, 1, 30)).otherwise(text).alias("payload")))


def provider_arrays(spark, d):
    """Observations of all arrays by horizon, metric, statistic and lookback, and the number of payloads that do not parse."""
    by = ["symbol", "horizon", "metric", "statistic", "lookback"]
    o = pp.observations(_payloads(spark, d), unparsed=True).groupBy(*by).agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"), F.sum("analysts").alias("analysts"))
    none = spark.range(1).select(F.lit(pp.UNPARSED).alias("metric"), F.lit(0).cast("long").alias("n"))  # told also where all parse
    return o.unionByName(none, allowMissingColumns=True).groupBy(*by).agg(F.sum("n").alias("n"), F.max("total").alias("total"), F.max("analysts").alias("analysts"))


def provider_releases(spark, d):
    """Releases by symbol and year, with the mean surprise in percent."""
    e = pp.releases(_payloads(spark, d))
    return e.groupBy("symbol", F.year("event_date").alias("year")).agg(F.count("*").alias("n"), F.round(F.avg("surprise_pct"), 6).alias("surprise_pct"), F.round(F.sum(F.col("reported_eps") - F.col("estimated_eps")), 2).alias("beat"))


QUERIES = {f.__name__: f for f in (provider_arrays, provider_releases)}
_GOOD = "g AS (SELECT *, 'S' || (l_orderkey % 50) AS symbol, ['FQ1', 'FQ2', 'FY1', 'FY2'][CAST((l_linenumber - 1) % 4 + 1 AS BIGINT)] AS horizon FROM lineitem WHERE l_orderkey % 40 <> 0)"
_ROW = lambda metric, statistic, lookback, value: f"SELECT symbol, horizon, '{metric}' AS metric, '{statistic}' AS statistic, {lookback} AS lookback, l_linenumber AS a, {value} AS v FROM f"
_LONG = " UNION ALL ".join(
    [_ROW("eps", "average", k, f"l_quantity + {k}") for k in (0, 7, 30, 90)]
    + [_ROW(m, "low", 0, "CASE WHEN l_discount > 0 THEN l_quantity * 0.5 END") for m in ("eps", "revenue")]
    + [_ROW(m, "high", 0, "l_quantity * 2") for m in ("eps", "revenue")]
    + [_ROW("revenue", "average", 0, "l_extendedprice"), _ROW("eps_revision", "up", 30, "l_discount * 100"), _ROW("eps_revision", "down", 30, "l_tax * 100")]
)
SQL = {
    "provider_arrays": f"""WITH {_GOOD}, f AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY l_orderkey, horizon ORDER BY l_linenumber, l_partkey, l_suppkey) = 1), u AS ({_LONG})
        SELECT symbol, horizon, metric, statistic, CAST(lookback AS INTEGER) AS lookback, count(*) AS n, round(sum(v), 2) AS total, CAST(sum(a) AS BIGINT) AS analysts FROM u WHERE v IS NOT NULL GROUP BY ALL
        UNION ALL SELECT NULL, NULL, 'unparsed', NULL, NULL, count(DISTINCT l_orderkey), NULL, NULL FROM lineitem WHERE l_orderkey % 40 = 0""",
    "provider_releases": f"""WITH {_GOOD} SELECT symbol, CAST(year(l_shipdate) AS INTEGER) AS year, count(*) AS n, round(avg(CASE WHEN s <= 1 THEN s * 100 ELSE s END), 6) AS surprise_pct, round(sum(1.0::DOUBLE), 2) AS beat
        FROM (SELECT *, CASE WHEN l_linenumber % 2 = 0 THEN l_discount ELSE l_quantity END AS s FROM g) GROUP BY ALL""",
}
