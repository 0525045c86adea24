"""Backtests, evaluations of scores, weight vectors, market risk."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import technical as t
from ..functions.semantics import divide
from ..functions.sliding import with_sliding_percentiles
from ..operators.asof import month_ends, snapshot
from ..plans import backtest as b
from ..plans import lab
from ..sources.views import benchmark, price_daily, sql, trading_days
from .scoring import FACTORS, factors, snapshots

GOOD = {"mom_1m": True, "high_gap": True}


def _calendar(spark, d):
    return b.rebalance_calendar(trading_days(spark, d))


def rebalance_calendar(spark, d):
    return _calendar(spark, d)


def _signals(spark, d):
    """Values known on each signal date, at most 540 days old."""
    dates = _calendar(spark, d).select(F.col("signal_date").alias("trade_date"))
    out = snapshot(factors(spark, d), dates, ["security_id", "factor_id"], max_age=540)
    return out.withColumnsRenamed({"trade_date": "signal_date", "source_trade_date": "source_date"})


def signal_values_batch(spark, d):
    return _signals(spark, d).select("signal_date", "security_id", "factor_id", "factor_value", "source_date")


def _positions(spark, d):
    return b.candidates(_signals(spark, d), GOOD, 3)


def candidates(spark, d):
    return _positions(spark, d).select("signal_date", "security_id", F.round("score", 4).alias("score"), "position", F.round("weight", 6).alias("weight"))


#: Of the candidates: a positive month, the upper half of the gap to the high, and a price not far above its average.
SCREENED = [{"factor_id": "mom_1m", "op": ">", "value": 0}, {"factor_id": "high_gap", "op": "top_percent", "value": 50}, {"factor_id": "na_ratio", "op": "between", "value": (-20, 40)}]


def candidates_screened(spark, d):
    """Candidates among the securities that meet all conditions on the signal date."""
    out = b.candidates(_signals(spark, d), GOOD, 3, SCREENED)
    return out.select("signal_date", "security_id", F.round("score", 4).alias("score"), "position", F.round("weight", 6).alias("weight"))


def _daily(spark, d):
    prices = price_daily(spark, d)
    return b.segment_returns(_positions(spark, d), _calendar(spark, d), b.daily_returns(prices))


def segment_returns(spark, d):
    return _daily(spark, d).select("segment_id", "trade_date", F.round("daily_return", 9).alias("daily_return"), "n_held")


def nav_curve(spark, d):
    return b.nav_curve(_daily(spark, d)).select("trade_date", F.round(F.log("nav"), 6).alias("log_nav"), F.round("drawdown", 6).alias("drawdown"))


def annual_returns(spark, d):
    return b.annual_returns(b.nav_curve(_daily(spark, d))).select("year", F.round(F.log1p("annual_return"), 6).alias("log_return"))


def backtest_summary(spark, d):
    s = b.summary(b.nav_curve(_daily(spark, d)))
    return s.select("n_days", *(F.round(c, 5).alias(c) for c in ("volatility", "sharpe", "t_stat", "max_drawdown", "win_rate")), F.round(F.log1p("cagr"), 5).alias("log_growth"))


def weight_vector_grid(spark, d):
    """Eleven blends of two factors; for each the mean following month's return of its two best securities a month."""
    rows = snapshots(spark, d).groupBy("trade_date", "security_id").agg(*(F.max(F.when(F.col("factor_id") == f, F.col("factor_value"))).alias(f) for f in GOOD)).where("mom_1m IS NOT NULL AND high_gap IS NOT NULL")
    panel = rows.join(_forward(spark, d, 1), ["trade_date", "security_id"]).where("forward IS NOT NULL")
    vectors = spark.range(11).select(F.col("id").alias("vector"), (F.col("id") / 10).alias("w_mom_1m"), (1 - F.col("id") / 10).alias("w_high_gap"))
    best = lab.daily_best(panel, vectors, ["mom_1m", "high_gap"], 2)
    return best.groupBy("vector").agg(F.sum("n").alias("n"), F.round(F.sum("total") / F.sum("n"), 6).alias("mean_return"))


def _month_prices(spark, d):
    """Close known at each month's end."""
    p = price_daily(spark, d).select("security_id", "trade_date", "close")
    return snapshot(p, month_ends(trading_days(spark, d)), ["security_id"])


def _forward(spark, d, k):
    w = Window.partitionBy("security_id").orderBy("trade_date")
    return _month_prices(spark, d).select("trade_date", "security_id", (divide(F.lead("close", k).over(w), "close") - 1).alias("forward"))


def _score(spark, d):
    return snapshots(spark, d).where("factor_id = 'high_gap'").select("trade_date", "security_id", F.col("factor_value").alias("value"))


def eval_ic(spark, d):
    return b.information_coefficient(_score(spark, d), _forward(spark, d, 1)).select("trade_date", "n", F.round("ic", 6).alias("ic"))


def eval_decay(spark, d):
    """Mean coefficient against what followed 1, 2 and 3 months later."""
    out = None
    for k in (1, 2, 3):
        w = Window.partitionBy("security_id").orderBy("trade_date")
        step = _month_prices(spark, d).select("trade_date", "security_id", (divide(F.lead("close", k).over(w), F.lead("close", k - 1).over(w) if k > 1 else F.col("close")) - 1).alias("forward"))
        one = b.information_coefficient(_score(spark, d), step).agg(F.round(F.avg("ic"), 6).alias("mean_ic"), F.count("*").alias("n_dates")).withColumn("horizon", F.lit(k))
        out = one if out is None else out.unionByName(one)
    return out


def eval_bucket_return(spark, d):
    return b.bucket_returns(_score(spark, d), _forward(spark, d, 1)).select("trade_date", "bucket", "n", F.round("mean_return", 6).alias("mean_return"))


def eval_turnover(spark, d):
    """Share of a signal date's positions that the one before did not have."""
    cal = _calendar(spark, d)
    held = _positions(spark, d).join(F.broadcast(cal.select("segment_id", "signal_date")), "signal_date").select("segment_id", "signal_date", "security_id")
    before = held.select((F.col("segment_id") + 1).alias("segment_id"), "security_id", F.lit(1).alias("old"))
    return held.join(before, ["segment_id", "security_id"], "left").groupBy("signal_date").agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("old").isNull(), 1.0).otherwise(0.0)), 6).alias("turnover"))


def risk_appetite_daily(spark, d):
    """Each month end's regression of 6-month excess returns on volatility across securities."""
    w = t.security_days()
    p = price_daily(spark, d).withColumn("ret", divide("close", F.lag("close").over(w)) - 1)
    p = p.select("security_id", "trade_date", F.round(t.momentum(F.col("close"), 0, 126), 6).alias("r"), F.round(t.at_least(F.stddev_samp("ret").over(t.rows(w, 126)), F.col("ret"), t.rows(w, 126), 60), 6).alias("v")).where("r IS NOT NULL AND v IS NOT NULL")
    s = snapshot(p, month_ends(p), ["security_id"])
    return s.groupBy("trade_date").agg(F.count("*").alias("n"), F.round(F.regr_slope("r", "v"), 5).alias("slope"), F.round(F.regr_intercept("r", "v"), 5).alias("intercept"), F.round(F.regr_r2("r", "v"), 5).alias("r2")).where("n >= 5")


def market_stress(spark, d):
    """Index volatility and drawdown, their percentiles within 252 rows, and a regime."""
    one = Window.partitionBy(F.lit(0)).orderBy("trade_date")  # an index is one series
    i = benchmark(price_daily(spark, d)).withColumn("ret", divide("index_close", F.lag("index_close").over(one)) - 1)
    i = i.withColumn("vol", F.round(F.when(F.count("ret").over(t.rows(one, 20)) >= 20, F.stddev_samp("ret").over(t.rows(one, 20))), 9)).withColumn("drawdown", F.round(F.col("index_close") / F.max("index_close").over(t.rows(one, 63)) - 1, 9))
    i = with_sliding_percentiles(i, None, "trade_date", {"vol_place": ("vol", False), "drawdown_place": ("drawdown", True)}, 252, 60)
    score = F.round(0.6 * F.col("vol_place") + 0.4 * F.col("drawdown_place"), 4)
    return i.select("trade_date", score.alias("stress"), F.when(score >= 70, "stress").when(score <= 30, "calm").when(score.isNotNull(), "normal").alias("regime"))


QUERIES = {f.__name__: f for f in (rebalance_calendar, signal_values_batch, candidates, candidates_screened, segment_returns, nav_curve, annual_returns, backtest_summary, weight_vector_grid, eval_ic, eval_decay, eval_bucket_return, eval_turnover, risk_appetite_daily, market_stress)}

CAL = {
    "days": "SELECT trade_date, lag(trade_date) OVER (ORDER BY trade_date) AS signal_date, date_trunc('quarter', trade_date) AS q FROM (SELECT DISTINCT trade_date FROM price_daily)",
    "firsts": "SELECT trade_date AS rebalance_date, signal_date, CAST(row_number() OVER (ORDER BY trade_date) AS INTEGER) AS segment_id, lead(trade_date) OVER (ORDER BY trade_date) AS next_date FROM (SELECT *, lag(q) OVER (ORDER BY trade_date) AS b FROM days) WHERE b IS NULL OR b <> q",
    "cal": "SELECT segment_id, rebalance_date, signal_date, next_date FROM firsts WHERE signal_date IS NOT NULL",
}
SIG = FACTORS | CAL | {
    "sspine": "SELECT security_id, factor_id, signal_date FROM (SELECT DISTINCT security_id, factor_id FROM factors), cal",
    "signals": "SELECT s.signal_date, s.security_id, s.factor_id, f.factor_value, f.trade_date AS source_date FROM sspine s ASOF JOIN factors f ON s.security_id = f.security_id AND s.factor_id = f.factor_id AND s.signal_date >= f.trade_date WHERE s.signal_date - f.trade_date <= 540",
    "pct": "SELECT *, CASE WHEN n = 1 THEN 100.0 ELSE (n - r) / (n - 1) * 100 END AS s FROM (SELECT *, count(*) OVER (PARTITION BY signal_date, factor_id) AS n, row_number() OVER (PARTITION BY signal_date, factor_id ORDER BY factor_value DESC, security_id) AS r FROM signals WHERE factor_id IN ('mom_1m', 'high_gap'))",
    "pos": "SELECT *, 1.0 / count(*) OVER (PARTITION BY signal_date) AS weight FROM (SELECT *, CAST(row_number() OVER (PARTITION BY signal_date ORDER BY score DESC, security_id) AS INTEGER) AS position FROM (SELECT signal_date, security_id, avg(s) AS score FROM pct GROUP BY 1, 2 HAVING count(*) = 2)) WHERE position <= 3",
}
DAILY = SIG | {
    "rets": "SELECT security_id, trade_date, close / lag(close) OVER (PARTITION BY security_id ORDER BY trade_date) - 1 AS ret FROM price_daily",
    "span": "SELECT trade_date, segment_id, signal_date FROM (SELECT DISTINCT trade_date FROM price_daily) JOIN cal ON trade_date > rebalance_date AND (next_date IS NULL OR trade_date <= next_date)",
    "held": "SELECT segment_id, trade_date, avg(ret) AS r, count(ret) AS n FROM span JOIN pos USING (signal_date) JOIN rets USING (security_id, trade_date) GROUP BY 1, 2",
    "daily": "SELECT segment_id, trade_date, coalesce(r, 0.0) - CASE WHEN row_number() OVER (PARTITION BY segment_id ORDER BY trade_date) = 1 THEN 0.001 ELSE 0.0 END::DOUBLE AS daily_return, coalesce(n, 0) AS n_held FROM span LEFT JOIN held USING (segment_id, trade_date)",
    "curve": "SELECT *, nav / greatest(max(nav) OVER (ORDER BY trade_date ROWS UNBOUNDED PRECEDING), 1.0) - 1 AS drawdown FROM (SELECT *, exp(sum(ln(1 + greatest(daily_return, -0.999999))) OVER (ORDER BY trade_date ROWS UNBOUNDED PRECEDING)) AS nav FROM daily)",
}
MONTH = {"mends": "SELECT max(trade_date) AS d FROM price_daily GROUP BY date_trunc('month', trade_date)", "mp": "SELECT s.d AS trade_date, s.security_id, p.close FROM (SELECT security_id, d FROM (SELECT security_id, min(trade_date) AS f FROM price_daily GROUP BY 1), mends WHERE d >= f) s ASOF JOIN price_daily p ON s.security_id = p.security_id AND s.d >= p.trade_date"}
_lead = lambda k: f"lead(close, {k}) OVER (PARTITION BY security_id ORDER BY trade_date)"
EVAL = FACTORS | MONTH | {"fw": f"SELECT trade_date, security_id, {_lead(1)} / close - 1 AS forward FROM mp", "sc": "SELECT trade_date, security_id, factor_value AS value FROM snaps WHERE factor_id = 'high_gap'"}
_IC = "SELECT trade_date, count(*) AS n, corr(a, b) AS ic FROM (SELECT trade_date, row_number() OVER (PARTITION BY trade_date ORDER BY value, security_id) AS a, row_number() OVER (PARTITION BY trade_date ORDER BY forward, security_id) AS b FROM sc JOIN ({f}) USING (trade_date, security_id) WHERE forward IS NOT NULL) GROUP BY 1 HAVING count(*) >= 5"
_place = lambda c, op: f"CASE WHEN count({c}) OVER y >= 60 THEN (len(list_filter(list({c}) FILTER (WHERE {c} IS NOT NULL) OVER y, lambda x: x {op} {c})) + (len(list_filter(list({c}) FILTER (WHERE {c} IS NOT NULL) OVER y, lambda x: x = {c})) + 1) / 2.0) / count({c}) OVER y * 100 END"
P, CLOSE = "price_daily", "close"
STRESS_SQL = {
    "i": "SELECT trade_date, round(CASE WHEN count(ret) OVER v >= 20 THEN stddev_samp(ret) OVER v END, 9) AS vol, round(index_close / max(index_close) OVER d - 1, 9) AS dd FROM (SELECT *, index_close / lag(index_close) OVER (ORDER BY trade_date) - 1 AS ret FROM benchmark_index) WINDOW v AS (ORDER BY trade_date ROWS 19 PRECEDING), d AS (ORDER BY trade_date ROWS 62 PRECEDING)",
    "world": f"SELECT trade_date, round(0.6 * ({_place('vol', '<')}) + 0.4 * ({_place('dd', '>')}), 4) AS stress FROM i WINDOW y AS (ORDER BY trade_date ROWS 251 PRECEDING)",
}
SQL = {
    "rebalance_calendar": sql(P, "SELECT * FROM cal", **CAL),
    "signal_values_batch": sql(P, "SELECT * FROM signals", **SIG),
    "candidates": sql(P, "SELECT signal_date, security_id, round(score, 4) AS score, position, round(weight, 6) AS weight FROM pos", **SIG),
    "candidates_screened": sql(P, "SELECT signal_date, security_id, round(score, 4) AS score, position, round(weight, 6) AS weight FROM pos2", **SIG,
        ok="SELECT signal_date, security_id FROM signals a WHERE factor_id = 'mom_1m' AND factor_value > 0 INTERSECT SELECT signal_date, security_id FROM signals WHERE factor_id = 'high_gap' QUALIFY row_number() OVER (PARTITION BY signal_date ORDER BY factor_value DESC, security_id) <= greatest(1, ceil(count(*) OVER (PARTITION BY signal_date) * 50 / 100.0)) INTERSECT SELECT signal_date, security_id FROM signals WHERE factor_id = 'na_ratio' AND factor_value >= -20 AND factor_value <= 40",
        pct2="SELECT *, CASE WHEN n = 1 THEN 100.0 ELSE (n - r) / (n - 1) * 100 END AS s FROM (SELECT *, count(*) OVER (PARTITION BY signal_date, factor_id) AS n, row_number() OVER (PARTITION BY signal_date, factor_id ORDER BY factor_value DESC, security_id) AS r FROM signals JOIN ok USING (signal_date, security_id) WHERE factor_id IN ('mom_1m', 'high_gap'))",
        pos2="SELECT *, 1.0 / count(*) OVER (PARTITION BY signal_date) AS weight FROM (SELECT *, CAST(row_number() OVER (PARTITION BY signal_date ORDER BY score DESC, security_id) AS INTEGER) AS position FROM (SELECT signal_date, security_id, avg(s) AS score FROM pct2 GROUP BY 1, 2 HAVING count(*) = 2)) WHERE position <= 3"),
    "segment_returns": sql(P, "SELECT segment_id, trade_date, round(daily_return, 9) AS daily_return, n_held FROM daily", **DAILY),
    "nav_curve": sql(P, "SELECT trade_date, round(ln(nav), 6) AS log_nav, round(drawdown, 6) AS drawdown FROM curve", **DAILY),
    "annual_returns": sql(P, "SELECT CAST(y AS INTEGER) AS year, round(ln(nav / lag(nav, 1, 1.0::DOUBLE) OVER (ORDER BY y)), 6) AS log_return FROM (SELECT year(trade_date) AS y, max_by(nav, trade_date) AS nav FROM curve GROUP BY 1)", **DAILY),
    "backtest_summary": sql(P, """SELECT n AS n_days, round(s * sqrt(252.0), 5) AS volatility, round(m / s * sqrt(252.0), 5) AS sharpe, round(m / (s / sqrt(n)), 5) AS t_stat, round(dd, 5) AS max_drawdown, round(w, 5) AS win_rate, round(ln(nav) / (days / 365.25), 5) AS log_growth FROM (
        SELECT count(*) AS n, stddev_samp(daily_return) AS s, avg(daily_return) AS m, min(drawdown) AS dd, count(*) FILTER (WHERE daily_return > 0) / count(*) FILTER (WHERE daily_return <> 0) AS w, max_by(nav, trade_date) AS nav, max(trade_date) - min(trade_date) AS days FROM curve)""", **DAILY),
    "weight_vector_grid": sql(P, """SELECT vector, count(*) AS n, round(avg(forward), 6) AS mean_return FROM (SELECT *, row_number() OVER (PARTITION BY vector, trade_date ORDER BY round(w * x + (1 - w) * y, 9) DESC, security_id) AS r FROM (
        SELECT p.*, forward, i AS vector, i / 10.0::DOUBLE AS w FROM (SELECT trade_date, security_id, max(CASE WHEN factor_id = 'mom_1m' THEN factor_value END) AS x, max(CASE WHEN factor_id = 'high_gap' THEN factor_value END) AS y FROM snaps GROUP BY 1, 2) p JOIN fw USING (trade_date, security_id), range(11) t(i) WHERE x IS NOT NULL AND y IS NOT NULL AND forward IS NOT NULL)) WHERE r <= 2 GROUP BY 1""", **EVAL),
    "eval_ic": sql(P, f"SELECT trade_date, n, round(ic, 6) AS ic FROM ({_IC.format(f='SELECT * FROM fw')})", **EVAL),
    "eval_decay": sql(P, " UNION ALL ".join(f"SELECT round(avg(ic), 6) AS mean_ic, count(*) AS n_dates, {k} AS horizon FROM ({_IC.format(f=f'SELECT trade_date, security_id, {_lead(k)} / {_lead(k - 1) if k > 1 else CLOSE} - 1 AS forward FROM mp')})" for k in (1, 2, 3)), **EVAL),
    "eval_bucket_return": sql(P, "SELECT trade_date, CAST(bucket AS INTEGER) AS bucket, count(*) AS n, round(avg(forward), 6) AS mean_return FROM (SELECT trade_date, forward, ntile(3) OVER (PARTITION BY trade_date ORDER BY value DESC, security_id) AS bucket FROM sc JOIN fw USING (trade_date, security_id) WHERE forward IS NOT NULL) GROUP BY 1, 2", **EVAL),
    "eval_turnover": sql(P, "SELECT h.signal_date, count(*) AS n, round(avg(CASE WHEN o.security_id IS NULL THEN 1.0 ELSE 0.0 END), 6) AS turnover FROM hp h LEFT JOIN hp o ON o.segment_id + 1 = h.segment_id AND o.security_id = h.security_id GROUP BY 1", **SIG, hp="SELECT segment_id, signal_date, security_id FROM pos JOIN cal USING (signal_date)"),
    "risk_appetite_daily": sql(P, """SELECT trade_date, count(*) AS n, round(regr_slope(r, v), 5) AS slope, round(regr_intercept(r, v), 5) AS intercept, round(regr_r2(r, v), 5) AS r2 FROM sn GROUP BY 1 HAVING count(*) >= 5""",
        pr="SELECT security_id, trade_date, round(close / lag(close, 126) OVER o - 1, 6) AS r, round(CASE WHEN count(ret) OVER f >= 60 THEN stddev_samp(ret) OVER f END, 6) AS v FROM (SELECT *, close / lag(close) OVER (PARTITION BY security_id ORDER BY trade_date) - 1 AS ret FROM price_daily) WINDOW o AS (PARTITION BY security_id ORDER BY trade_date), f AS (PARTITION BY security_id ORDER BY trade_date ROWS 125 PRECEDING)",
        pv="SELECT * FROM pr WHERE r IS NOT NULL AND v IS NOT NULL", me="SELECT max(trade_date) AS d FROM pv GROUP BY date_trunc('month', trade_date)",
        sn="SELECT s.d AS trade_date, s.security_id, p.r, p.v FROM (SELECT security_id, d FROM (SELECT security_id, min(trade_date) AS f FROM pv GROUP BY 1), me WHERE d >= f) s ASOF JOIN pv p ON s.security_id = p.security_id AND s.d >= p.trade_date"),
    "market_stress": sql("benchmark_index", "SELECT trade_date, stress, CASE WHEN stress >= 70 THEN 'stress' WHEN stress <= 30 THEN 'calm' WHEN stress IS NOT NULL THEN 'normal' END AS regime FROM world", **STRESS_SQL),
}
