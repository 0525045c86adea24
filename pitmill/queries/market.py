"""Prices, versions, technical factors, benchmarks."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import technical as t
from ..functions.semantics import divide, finite
from ..operators.asof import latest_version
from ..sources.views import benchmark, cut, price_daily, read, sql

KEYS = ["security_id", "trade_date"]
OVER = "OVER (PARTITION BY security_id ORDER BY trade_date"


def out(df, **columns):
    return df.select(*KEYS, *(F.round(c, 6).alias(k) for k, c in columns.items()))


def price_daily_from_lines(spark, d):
    return price_daily(spark, d)


def latest_version_prices(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("security"), F.col("l_partkey").alias("part"), F.col("l_extendedprice").alias("value"), F.to_date("l_shipdate").alias("updated_at"), "l_orderkey", "l_linenumber")
    return latest_version(rows, ["security", "part"], "updated_at", ["l_orderkey", "l_linenumber"]).select("security", "part", "value", "updated_at")


def factor_wide(spark, d):
    p = price_daily(spark, d)
    return out(p, na_20=t.moving_average(F.col("close"), 20), ret_1m=t.momentum(F.col("close"), 0, 21), high_52w=t.high_gap(F.col("close")))


def factor_melt_long(spark, d):
    """Only finite values become rows."""
    long = factor_wide(spark, d).unpivot(KEYS, ["na_20", "ret_1m", "high_52w"], "factor_id", "factor_value")
    return long.withColumn("factor_value", finite("factor_value")).where("factor_value IS NOT NULL")


def factor_coverage(spark, d):
    names = ["na_20", "ret_1m", "high_52w"]
    one = factor_wide(spark, d).agg(F.count("*").alias("n_rows"), *(F.count(finite(c)).alias(c) for c in names))
    return one.unpivot(["n_rows"], names, "factor_id", "n_values").withColumn("coverage", F.round(divide("n_values", "n_rows"), 6))


def moving_averages(spark, d):
    return out(price_daily(spark, d), **{f"na_{n}": t.moving_average(F.col("close"), n) for n in (5, 10, 20, 60, 120, 200)})


def momentum_columns():
    return {"ret_1m": t.momentum(F.col("close"), 0, 21), "tr_3_1": t.momentum(F.col("close"), 21, 63), "tr_6_1": t.momentum(F.col("close"), 21, 126), "tr_12_1": t.momentum(F.col("close"), 21, 252)}


def momentum(spark, d):
    return out(price_daily(spark, d), **momentum_columns())


def gap_columns():
    return {"high_52w_gap": t.high_gap(F.col("close"))}


def high_gap(spark, d):
    return out(price_daily(spark, d), **gap_columns())


def with_returns(p):
    return p.withColumn("ret", divide(F.col("close"), F.lag(F.col("close")).over(t.security_days())) - 1)


def volatility_columns():
    return {"vol_12_1_ann": t.skipped_volatility(F.col("ret")), "risk_adj_mom": divide(t.momentum(F.col("close"), 21, 252), t.skipped_volatility(F.col("ret")))}


def volatility_12_1(spark, d):
    return out(with_returns(price_daily(spark, d)), **volatility_columns())


def turnover_12_1(spark, d):
    p = price_daily(spark, d).withColumn("turnover", F.col("close") * F.col("volume"))
    return p.select(*KEYS, cut(t.skipped_mean(F.col("turnover")), 4).alias("adturn_12_1"))


def rolling_mdd(spark, d):
    return out(t.with_max_drawdown(with_returns(price_daily(spark, d))), mdd1yr_12_1_pct=F.col("max_drawdown"))


def k_ratio(spark, d):
    return out(t.with_k_ratio(price_daily(spark, d), 504, 252), k_ratio_3y=F.col("k_ratio"))


def bollinger(spark, d):
    lower, middle, upper = t.bollinger(F.col("close"))
    return out(price_daily(spark, d), lower=lower, middle=middle, upper=upper)


def williams(spark, d):
    return out(price_daily(spark, d), williams_r_14=t.williams_r(F.col("high"), F.col("low"), F.col("close")))


def cmf(spark, d):
    return out(price_daily(spark, d), cmf_20=t.chaikin_flow(F.col("high"), F.col("low"), F.col("close"), F.col("volume")), ad_line=t.accumulation(F.col("high"), F.col("low"), F.col("close"), F.col("volume")))


def mfi(spark, d):
    return out(t.with_money_flow(price_daily(spark, d)), mfi_14=F.col("mfi_14"))


def _wilder(spark, d):
    p = price_daily(spark, d).withColumn("change", F.col("close") - F.lag(F.col("close")).over(t.security_days()))
    gain, loss = F.greatest("change", F.lit(0.0)), F.greatest(-F.col("change"), F.lit(0.0))
    return p.withColumn("gain", F.when(F.col("change").isNotNull(), gain)).withColumn("loss", F.when(F.col("change").isNotNull(), loss)).where("change IS NOT NULL")


def rsi(spark, d):
    """Wilder's means of gains and losses; 100 without losses, 50 without both."""
    p = _wilder(spark, d)
    p = t.smoothed(p, "gain", {"up": (1 / 14, 14)})
    p = t.smoothed(p, "loss", {"down": (1 / 14, 14)})
    index = F.when((F.col("up") == 0) & (F.col("down") == 0), 50.0).when(F.col("down") == 0, 100.0).otherwise(100 - 100 / (1 + divide("up", "down")))
    return p.select(*KEYS, F.round(F.when(F.col("up").isNotNull(), index), 4).alias("rsi_14"))


def macd(spark, d):
    p = t.smoothed(price_daily(spark, d), "close", {"fast": (2 / 13, 12), "slow": (2 / 27, 26)}).withColumn("macd", F.col("fast") - F.col("slow"))
    p = t.smoothed(p.where("macd IS NOT NULL"), "macd", {"signal": (2 / 10, 9)})
    return p.select(*KEYS, F.round("macd", 4).alias("macd"), F.round("signal", 4).alias("signal"))


def ad_oscillator(spark, d):
    p = price_daily(spark, d).withColumn("ad", t.accumulation(F.col("high"), F.col("low"), F.col("close"), F.col("volume")))
    p = t.smoothed(p, "ad", {"fast": (2 / 4, 3), "slow": (2 / 11, 10)})
    return p.select(*KEYS, F.round(F.col("fast") - F.col("slow"), 4).alias("ad_oscillator"))


def weekly(p, value="close"):
    """Weeks end on Friday; the last value counts."""
    week, keys = F.next_day(F.date_sub("trade_date", 1), "FRI"), [c for c in ["security_id"] if c in p.columns]
    ends = p.groupBy(*keys, week.alias("_week")).agg(F.max(week).alias("week_end"), F.max_by(value, "trade_date").alias("last"))
    return ends.drop("_week")  # the week as an aggregate: a join's filter on it stays here, and what is below can be shared


def weekly_returns(spark, d):
    w = Window.partitionBy("security_id").orderBy("week_end")
    p = weekly(price_daily(spark, d))
    return p.select("security_id", "week_end", F.col("last").alias("close"), F.round(divide("last", F.lag("last").over(w)) - 1, 6).alias("weekly_return"))


def rolling_beta(spark, d):
    """Beta of 104 weeks, shrunk to 1 and clipped."""
    prices = price_daily(spark, d)
    own, index = weekly(prices), weekly(benchmark(prices), "index_close")
    w = Window.partitionBy("security_id").orderBy("week_end")
    one = own.withColumn("r", divide("last", F.lag("last").over(w)) - 1)
    market = index.select("week_end", F.col("last").alias("m_last"))
    both = one.join(F.broadcast(market), "week_end").withColumn("m", divide("m_last", F.lag("m_last").over(w)) - 1).where("r IS NOT NULL AND m IS NOT NULL")
    frame = t.rows(w, 104)
    raw = divide(F.covar_samp("r", "m").over(frame), F.nullif(F.var_samp("m").over(frame), F.lit(0.0)))
    beta = F.when(F.count("*").over(frame) >= 52, F.greatest(F.lit(0.2), F.least(F.lit(2.5), raw * 0.67 + 0.33)))
    return both.select("security_id", "week_end", F.round(beta, 6).alias("beta")).where("beta IS NOT NULL")


def chart_signals(spark, d):
    """Gap against the previous close, volume against its 20-row mean, trend by averages."""
    p = price_daily(spark, d).withColumn("before", F.lag(F.col("close")).over(t.security_days())).withColumn("mean_volume", t.moving_average(F.col("volume"), 20)).withColumn("short", t.moving_average(F.col("close"), 5)).withColumn("long", t.moving_average(F.col("close"), 20))
    gap = F.when(F.col("low") > F.col("before") * 1.02, "gap_up").when(F.col("high") < F.col("before") * 0.98, "gap_down").otherwise("none")
    surge = F.when(F.col("volume") > 2 * F.col("mean_volume"), "surge").when(F.col("volume") < 0.5 * F.col("mean_volume"), "dry").otherwise("normal")
    trend = F.when(F.col("long").isNull(), "unknown").when(F.col("short") > F.col("long"), "up").when(F.col("short") < F.col("long"), "down").otherwise("flat")
    return p.select(*KEYS, gap.alias("gap"), surge.alias("volume_signal"), trend.alias("trend"))


def stock_introduction(spark, d):
    """Last close with the highest and lowest of the 365 days up to each security's last day."""
    p = price_daily(spark, d)
    last = p.groupBy("security_id").agg(F.max("trade_date").alias("last_date"))
    year = p.join(last, "security_id").where(F.datediff("last_date", "trade_date") < 365)
    return year.groupBy("security_id").agg(F.max("high").alias("high_52w"), F.min("low").alias("low_52w"), F.max_by("close", "trade_date").alias("last_close"))


QUERIES = {f.__name__: f for f in (price_daily_from_lines, latest_version_prices, factor_melt_long, factor_coverage, moving_averages, momentum, high_gap, volatility_12_1, turnover_12_1, rolling_mdd, k_ratio, bollinger, williams, cmf, mfi, rsi, macd, ad_oscillator, weekly_returns, rolling_beta, chart_signals, stock_introduction)}


def _ma(n, x="close"):
    return f"CASE WHEN count({x}) {OVER} ROWS {n - 1} PRECEDING) >= {n} THEN avg({x}) {OVER} ROWS {n - 1} PRECEDING) END"


def _skip(f, x):
    return f"CASE WHEN count({x}) {OVER} ROWS BETWEEN 251 PRECEDING AND 21 PRECEDING) >= 60 THEN {f}({x}) {OVER} ROWS BETWEEN 251 PRECEDING AND 21 PRECEDING) END"


def _lag(n, x="close"):
    return f"lag({x}, {n}) {OVER})"


_GAP = f"CASE WHEN count(close) {OVER} ROWS 251 PRECEDING) >= 20 THEN close / max(close) {OVER} ROWS 251 PRECEDING) - 1 END"
_WIDE = f"SELECT security_id, trade_date, round({_ma(20)}, 6) AS na_20, round(close / {_lag(21)} - 1, 6) AS ret_1m, round({_GAP}, 6) AS high_52w FROM price_daily"
_RET = f"SELECT *, close / lag(close) {OVER}) - 1 AS ret FROM price_daily"
_MULT = "coalesce(((close - low) - (high - close)) / nullif(high - low, 0), 0)"
_EWM = """SELECT security_id, trade_date, x, n, x AS m FROM src WHERE n = 1
    UNION ALL SELECT s.security_id, s.trade_date, s.x, s.n, s.x * {a} + e.m * (1 - {a}) FROM {e} e JOIN src s ON s.security_id = e.security_id AND s.n = e.n + 1"""
_WEEK = "trade_date + CAST((12 - isodow(trade_date)) % 7 AS INTEGER)"

SQL = {
    "price_daily_from_lines": sql("price_daily", "SELECT * FROM price_daily"),
    "latest_version_prices": """SELECT l_suppkey AS security, l_partkey AS part, l_extendedprice AS value, CAST(l_shipdate AS DATE) AS updated_at FROM lineitem
        QUALIFY row_number() OVER (PARTITION BY l_suppkey, l_partkey ORDER BY CAST(l_shipdate AS DATE) DESC, l_orderkey DESC, l_linenumber DESC) = 1""",
    "factor_melt_long": sql("price_daily", "SELECT security_id, trade_date, factor_id, factor_value FROM (UNPIVOT wide ON na_20, ret_1m, high_52w INTO NAME factor_id VALUE factor_value)", wide=_WIDE),
    "factor_coverage": sql(
        "price_daily", """SELECT n_rows, 'na_20' AS factor_id, a AS n_values, round(a / n_rows, 6) AS coverage FROM c UNION ALL SELECT n_rows, 'ret_1m', b, round(b / n_rows, 6) FROM c
        UNION ALL SELECT n_rows, 'high_52w', h, round(h / n_rows, 6) FROM c""", wide=_WIDE, c="SELECT count(*) AS n_rows, count(na_20) AS a, count(ret_1m) AS b, count(high_52w) AS h FROM wide"),
    "moving_averages": sql("price_daily", "SELECT security_id, trade_date, " + ", ".join(f"round({_ma(n)}, 6) AS na_{n}" for n in (5, 10, 20, 60, 120, 200)) + " FROM price_daily"),
    "momentum": sql("price_daily", f"SELECT security_id, trade_date, round(close / {_lag(21)} - 1, 6) AS ret_1m, round({_lag(21)} / {_lag(63)} - 1, 6) AS tr_3_1, round({_lag(21)} / {_lag(126)} - 1, 6) AS tr_6_1, round({_lag(21)} / {_lag(252)} - 1, 6) AS tr_12_1 FROM price_daily"),
    "high_gap": sql("price_daily", f"SELECT security_id, trade_date, round({_GAP}, 6) AS high_52w_gap FROM price_daily"),
    "volatility_12_1": sql("price_daily", f"SELECT security_id, trade_date, round(v, 6) AS vol_12_1_ann, round(mom / v, 6) AS risk_adj_mom FROM (SELECT security_id, trade_date, {_skip('stddev_samp', 'ret')} * sqrt(252.0) AS v, {_lag(21)} / {_lag(252)} - 1 AS mom FROM r)", r=_RET),
    "turnover_12_1": sql("price_daily", f"SELECT security_id, trade_date, floor(({_skip('avg', 'turnover')}) * 1e4 + 1e-6) / 1e4 AS adturn_12_1 FROM (SELECT *, close * volume AS turnover FROM price_daily)"),
    "rolling_mdd": sql("price_daily", f"""SELECT security_id, trade_date, round(CASE WHEN n >= 60 THEN list_reduce(list_prepend(struct_pack(w := 1.0::DOUBLE, p := 1.0::DOUBLE, d := 0.0::DOUBLE), list_transform(rs, lambda r: struct_pack(w := r, p := 0.0::DOUBLE, d := 0.0::DOUBLE))),
        lambda s, x: struct_pack(w := s.w * (1 + x.w), p := greatest(s.p, s.w * (1 + x.w)), d := least(s.d, s.w * (1 + x.w) / greatest(s.p, s.w * (1 + x.w)) - 1))).d * 100 END, 6) AS mdd1yr_12_1_pct
        FROM (SELECT security_id, trade_date, count(ret) {OVER} ROWS BETWEEN 251 PRECEDING AND 21 PRECEDING) AS n, list(ret) FILTER (WHERE ret IS NOT NULL) {OVER} ROWS BETWEEN 251 PRECEDING AND 21 PRECEDING) AS rs FROM r)""", r=_RET),
    "k_ratio": sql("price_daily", f"""SELECT security_id, trade_date, round(CASE WHEN n >= 252 THEN s / (n * nullif(sqrt(greatest(syy - s * sxy, 0) / ((n - 2) * sxx)), 0)) END, 6) AS k_ratio_3y FROM (
        SELECT security_id, trade_date, count(y) {OVER} ROWS 503 PRECEDING) AS n, regr_slope(y, x) {OVER} ROWS 503 PRECEDING) AS s, regr_syy(y, x) {OVER} ROWS 503 PRECEDING) AS syy,
        regr_sxy(y, x) {OVER} ROWS 503 PRECEDING) AS sxy, regr_sxx(y, x) {OVER} ROWS 503 PRECEDING) AS sxx FROM (SELECT *, ln(close) AS y, CAST(row_number() {OVER}) AS DOUBLE) AS x FROM price_daily))"""),
    "bollinger": sql("price_daily", f"SELECT security_id, trade_date, round(m - s, 6) AS lower, round(m, 6) AS middle, round(m + s, 6) AS upper FROM (SELECT security_id, trade_date, {_ma(20)} AS m, 2 * stddev_pop(close) {OVER} ROWS 19 PRECEDING) AS s FROM price_daily)"),
    "williams": sql("price_daily", f"SELECT security_id, trade_date, round(CASE WHEN n >= 14 THEN (h - close) / nullif(h - l, 0) * -100 END, 6) AS williams_r_14 FROM (SELECT *, max(high) {OVER} ROWS 13 PRECEDING) AS h, min(low) {OVER} ROWS 13 PRECEDING) AS l, count(*) {OVER} ROWS 13 PRECEDING) AS n FROM price_daily)"),
    "cmf": sql("price_daily", f"""SELECT security_id, trade_date, round(CASE WHEN count(*) {OVER} ROWS 19 PRECEDING) >= 20 THEN sum({_MULT} * volume) {OVER} ROWS 19 PRECEDING) / nullif(sum(volume) {OVER} ROWS 19 PRECEDING), 0) END, 6) AS cmf_20,
        round(sum({_MULT} * volume) {OVER} ROWS UNBOUNDED PRECEDING), 6) AS ad_line FROM price_daily"""),
    "mfi": sql("price_daily", f"""SELECT security_id, trade_date, round(CASE WHEN n >= 14 THEN CASE WHEN g = 0 AND l = 0 THEN 50.0 WHEN l = 0 THEN 100.0 ELSE 100 - 100 / (1 + g / l) END END, 6) AS mfi_14 FROM (
        SELECT security_id, trade_date, count(b) {OVER} ROWS 13 PRECEDING) AS n, sum(CASE WHEN tp > b THEN tp * volume ELSE 0.0 END) {OVER} ROWS 13 PRECEDING) AS g, sum(CASE WHEN tp < b THEN tp * volume ELSE 0.0 END) {OVER} ROWS 13 PRECEDING) AS l
        FROM (SELECT *, lag(tp) {OVER}) AS b FROM (SELECT *, (high + low + close) / 3 AS tp FROM price_daily)))"""),
    "weekly_returns": sql("price_daily", "SELECT security_id, week_end, close, round(close / lag(close) OVER (PARTITION BY security_id ORDER BY week_end) - 1, 6) AS weekly_return FROM w", w=f"SELECT security_id, {_WEEK} AS week_end, max_by(close, trade_date) AS close FROM price_daily GROUP BY 1, 2"),
    "rolling_beta": sql("price_daily benchmark_index", """SELECT security_id, week_end, round(greatest(0.2, least(2.5, c / nullif(v, 0) * 0.67 + 0.33)), 6) AS beta FROM (
        SELECT security_id, week_end, covar_samp(r, m) OVER f AS c, var_samp(m) OVER f AS v, count(*) OVER f AS n FROM b WHERE r IS NOT NULL AND m IS NOT NULL WINDOW f AS (PARTITION BY security_id ORDER BY week_end ROWS 103 PRECEDING)) WHERE n >= 52 AND c / nullif(v, 0) IS NOT NULL""",
        w=f"SELECT security_id, {_WEEK} AS week_end, max_by(close, trade_date) AS close FROM price_daily GROUP BY 1, 2", i=f"SELECT {_WEEK} AS week_end, max_by(index_close, trade_date) AS x FROM benchmark_index GROUP BY 1",
        b="SELECT security_id, week_end, r, x / lag(x) OVER (PARTITION BY security_id ORDER BY week_end) - 1 AS m FROM (SELECT *, close / lag(close) OVER (PARTITION BY security_id ORDER BY week_end) - 1 AS r FROM w) JOIN i USING (week_end)"),
    "chart_signals": sql("price_daily", f"""SELECT security_id, trade_date, CASE WHEN low > b * 1.02 THEN 'gap_up' WHEN high < b * 0.98 THEN 'gap_down' ELSE 'none' END AS gap,
        CASE WHEN volume > 2 * mv THEN 'surge' WHEN volume < 0.5 * mv THEN 'dry' ELSE 'normal' END AS volume_signal,
        CASE WHEN l20 IS NULL THEN 'unknown' WHEN l5 > l20 THEN 'up' WHEN l5 < l20 THEN 'down' ELSE 'flat' END AS trend
        FROM (SELECT *, lag(close) {OVER}) AS b, {_ma(20, 'volume')} AS mv, {_ma(5)} AS l5, {_ma(20)} AS l20 FROM price_daily)"""),
    "stock_introduction": sql("price_daily", "SELECT security_id, max(high) AS high_52w, min(low) AS low_52w, max_by(close, trade_date) AS last_close FROM price_daily JOIN (SELECT security_id, max(trade_date) AS ld FROM price_daily GROUP BY 1) USING (security_id) WHERE ld - trade_date < 365 GROUP BY 1"),
}


def _recursive(source, steps, body):
    """Exponential means as recursive CTEs; ``steps`` gives their names and weights."""
    text = sql("price_daily", body, src=source, **{name: _EWM.format(a=a, e=name) for name, a in steps.items()})
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


SQL["macd"] = _recursive(
    f"SELECT security_id, trade_date, close AS x, row_number() {OVER}) AS n FROM price_daily", {"fast": "(2.0::DOUBLE / 13)", "slow": "(2.0::DOUBLE / 27)"},
    """, m AS (SELECT f.security_id, f.trade_date, f.m - s.m AS x, f.n - 25 AS n FROM fast f JOIN slow s USING (security_id, n) WHERE f.n >= 26),
    sig AS (SELECT security_id, trade_date, x, n, x AS m FROM m WHERE n = 1 UNION ALL SELECT s.security_id, s.trade_date, s.x, s.n, s.x * 0.2::DOUBLE + e.m * 0.8::DOUBLE FROM sig e JOIN m s ON s.security_id = e.security_id AND s.n = e.n + 1)
    SELECT security_id, trade_date, round(x, 4) AS macd, round(CASE WHEN n >= 9 THEN m END, 4) AS signal FROM sig""",
).replace(") , m AS", "), m AS")
SQL["ad_oscillator"] = _recursive(
    f"SELECT security_id, trade_date, sum({_MULT} * volume) {OVER} ROWS UNBOUNDED PRECEDING) AS x, row_number() {OVER}) AS n FROM price_daily", {"fast": "(2.0::DOUBLE / 4)", "slow": "(2.0::DOUBLE / 11)"},
    "SELECT f.security_id, f.trade_date, round(CASE WHEN f.n >= 10 THEN f.m - s.m END, 4) AS ad_oscillator FROM fast f JOIN slow s USING (security_id, n)",
)
SQL["rsi"] = sql(
    "price_daily",
    """SELECT security_id, trade_date, round(CASE WHEN n >= 14 THEN CASE WHEN u = 0 AND v = 0 THEN 50.0 WHEN v = 0 THEN 100.0 ELSE 100 - 100 / (1 + u / v) END END, 4) AS rsi_14 FROM e""",
    c=f"SELECT security_id, trade_date, ch, row_number() {OVER}) AS n FROM (SELECT security_id, trade_date, close - lag(close) {OVER}) AS ch FROM price_daily) WHERE ch IS NOT NULL",
    e="""SELECT security_id, trade_date, n, greatest(ch, 0.0) AS u, greatest(-ch, 0.0) AS v FROM c WHERE n = 1 UNION ALL
    SELECT c.security_id, c.trade_date, c.n, greatest(c.ch, 0.0) / 14 + e.u * 13 / 14, greatest(-c.ch, 0.0) / 14 + e.v * 13 / 14 FROM e JOIN c ON c.security_id = e.security_id AND c.n = e.n + 1""",
).replace("WITH ", "WITH RECURSIVE ", 1)
