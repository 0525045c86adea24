"""Risk of countries: four percentiles within their own history and the global score."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import technical as t
from ..functions.semantics import divide
from ..functions.sliding import with_sliding_percentiles
from ..sources.views import cut, price_daily, security_master, sql
from . import backtests

#: Rows of history, of volatility, of the highest price and of the return; weights of the local percentiles; share of the global score. Fixed values.
HISTORY, LEAST = 1260, 252
VOLATILITY, PEAK, RETURN = 20, 63, 126
WEIGHTS = {"residual_place": 0.35, "vol_place": 0.25, "drawdown_place": 0.25, "momentum_place": 0.15}
GLOBAL_SHARE = 0.25


def _nations(spark, d):
    """A day's average close of a nation, as its country fund."""
    p = price_daily(spark, d).join(security_master(spark, d).select("security_id", F.col("industry_group").alias("country")), "security_id")
    return p.groupBy("country", "trade_date").agg(cut(F.avg("close"), 4).alias("close"))


def country_indicators(spark, d):
    """Volatility, drawdown, momentum and what the day's line of return on volatility leaves of it."""
    w = Window.partitionBy("country").orderBy("trade_date")
    log = F.log("close")
    p = _nations(spark, d).withColumn("ret", log - F.lag(log).over(w))
    p = p.withColumn("vol", F.round(t.at_least(F.stddev_samp("ret").over(t.rows(w, VOLATILITY)), F.col("ret"), t.rows(w, VOLATILITY), VOLATILITY), 7))
    p = p.withColumn("drawdown", F.round(divide("close", F.max("close").over(t.rows(w, PEAK))) - 1, 7)).withColumn("momentum", F.round(log - F.lag(log, RETURN).over(w), 7))
    day = Window.partitionBy("trade_date")
    both = F.col("vol").isNotNull() & F.col("momentum").isNotNull()
    x, y = F.when(both, F.col("vol")), F.when(both, F.col("momentum"))
    line = F.regr_intercept(y, x).over(day) + F.regr_slope(y, x).over(day) * x
    return p.withColumn("residual", F.round(F.when(F.count(x).over(day) >= 12, y - line), 7)).select("country", "trade_date", "vol", "drawdown", "momentum", "residual")


def country_risk_scores(spark, d):
    """The country score of each day: a quarter global stress, the rest local percentiles within 1260 rows."""
    places = {"residual_place": ("residual", True), "vol_place": ("vol", False), "drawdown_place": ("drawdown", True), "momentum_place": ("momentum", True)}
    p = with_sliding_percentiles(country_indicators(spark, d), "country", "trade_date", places, HISTORY, LEAST)
    local = sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0))
    world = backtests.market_stress(spark, d).select("trade_date", "stress")
    out = p.join(world, "trade_date").withColumn("local_score", local).where("local_score IS NOT NULL AND stress IS NOT NULL")
    return out.select("country", "trade_date", F.round("local_score", 5).alias("local_score"), F.round(GLOBAL_SHARE * F.col("stress") + (1 - GLOBAL_SHARE) * F.col("local_score"), 5).alias("country_score"))


QUERIES = {f.__name__: f for f in (country_risk_scores,)}


def _place(c: str, sign: str) -> str:
    held = f"list({c}) FILTER (WHERE {c} IS NOT NULL) OVER (PARTITION BY country ORDER BY trade_date ROWS {HISTORY - 1} PRECEDING)"
    return f"CASE WHEN {c} IS NOT NULL AND len(l_{c}) >= {LEAST} THEN (len(list_filter(l_{c}, lambda x: x {sign} {c})) + (len(list_filter(l_{c}, lambda x: x = {c})) + 1) / 2.0) / len(l_{c}) * 100 END", f"{held} AS l_{c}"


_C = {c: _place(c, sign) for c, sign in (("residual", ">"), ("vol", "<"), ("drawdown", ">"), ("momentum", ">"))}
SQL = {
    "country_risk_scores": sql(
        "price_daily security_master benchmark_index",
        "SELECT country, trade_date, round(local, 5) AS local_score, round(0.25 * stress + 0.75 * local, 5) AS country_score FROM (SELECT *, 0.35 * residual_p + 0.25 * vol_p + 0.25 * drawdown_p + 0.15 * momentum_p AS local FROM placed) JOIN world USING (trade_date) WHERE local IS NOT NULL AND stress IS NOT NULL",
        **backtests.STRESS_SQL,
        n="SELECT industry_group AS country, trade_date, floor(avg(close) * 1e4 + 1e-6) / 1e4 AS close FROM price_daily JOIN security_master USING (security_id) GROUP BY 1, 2",
        r="SELECT *, ln(close) - lag(ln(close)) OVER w AS ret FROM n WINDOW w AS (PARTITION BY country ORDER BY trade_date)",
        ind=f"""SELECT country, trade_date, round(CASE WHEN count(ret) OVER v >= {VOLATILITY} THEN stddev_samp(ret) OVER v END, 7) AS vol, round(close / max(close) OVER (PARTITION BY country ORDER BY trade_date ROWS {PEAK - 1} PRECEDING) - 1, 7) AS drawdown,
        round(ln(close) - lag(ln(close), {RETURN}) OVER (PARTITION BY country ORDER BY trade_date), 7) AS momentum FROM r WINDOW v AS (PARTITION BY country ORDER BY trade_date ROWS {VOLATILITY - 1} PRECEDING)""",
        lines="SELECT trade_date, regr_intercept(momentum, vol) AS a, regr_slope(momentum, vol) AS b FROM ind WHERE vol IS NOT NULL AND momentum IS NOT NULL GROUP BY 1 HAVING count(*) >= 12",
        res="SELECT ind.*, round(momentum - (a + b * vol), 7) AS residual FROM ind LEFT JOIN lines USING (trade_date)",
        held="SELECT *, " + ", ".join(v[1] for v in _C.values()) + " FROM res",
        placed="SELECT country, trade_date, " + ", ".join(f"{v[0]} AS {c}_p" for c, v in _C.items()) + " FROM held",
    )
}
