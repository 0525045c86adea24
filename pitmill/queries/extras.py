"""Dividends by range, histories, coverage of dates, official consensus, risk by country, estimate variants."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.semantics import bounded, divide
from ..operators.consensus import validity
from ..operators.asof import asof_join
from ..operators.periods import annual
from ..plans.backtest import rebalance_calendar
from ..sources.views import benchmark, price_daily, read, reports, security_master, sql, statements
from . import backtests as bt
from . import rules_quality as rq
from . import scoring as sc
from .fundamentals import PERIODS, ttm, wide


def _by_day():
    return Window.partitionBy("security_id").orderBy("trade_date")


#: Lines that count as payments, by their quantity.
PAYING = "l_returnflag = 'N' AND l_discount >= 0.09"


def payments(spark, d):
    lines = read(spark, d, "lineitem").where(PAYING)
    return lines.groupBy(F.concat(F.lit("SEC_US_"), F.col("l_suppkey").cast("string")).alias("security_id"), F.to_date("l_shipdate").alias("trade_date")).agg(F.sum("l_quantity").alias("paid"))


def paid_365():
    """By days and not by rows, in the order that windows of rows have too."""
    return F.expr("coalesce(sum(paid) OVER (PARTITION BY security_id ORDER BY trade_date RANGE BETWEEN INTERVAL '364' DAY PRECEDING AND CURRENT ROW), 0.0D)")


def us_dividends(spark, d):
    """Payments of a day, and their sum over the trailing 365 days, by day numbers and not by rows."""
    p = price_daily(spark, d).select("security_id", "trade_date").join(payments(spark, d), ["security_id", "trade_date"], "left")
    return p.select("security_id", "trade_date", paid_365().alias("paid_365"))


def roe_three_years(spark, d):
    """Mean of three years' ROE, only over consecutive years."""
    y = annual(wide(spark, d)).select("security_id", "fiscal_year", divide("NI", "SEQ").alias("roe"))
    w = Window.partitionBy("security_id").orderBy("fiscal_year")
    f = w.rowsBetween(-2, 0)
    ok = (F.count("roe").over(f) == 3) & (F.col("fiscal_year") - F.lag("fiscal_year", 2).over(w) == 2)
    return y.select("security_id", "fiscal_year", F.round(F.when(ok, F.avg("roe").over(f)), 8).alias("roe_3y"))


def neighbour_outliers(spark, d, times: float = 100.0):
    """Amounts of more than ``times`` both neighbours' size become NULL; every third quarter's inventory is published in the wrong unit."""
    w = Window.partitionBy("security_id", "canonical_id").orderBy("fiscal_year", "fiscal_month")
    near = F.greatest(F.abs(F.lag("amount").over(w)), F.abs(F.lead("amount").over(w)))
    both = F.lag("amount").over(w).isNotNull() & F.lead("amount").over(w).isNotNull()
    wrong = (F.col("canonical_id") == "INVT") & (F.col("fiscal_month") == 9)
    s = statements(spark, d).where("statement_type = 'BS'").withColumn("amount", F.when(wrong, F.col("amount") * 1000).otherwise(F.col("amount")))
    return s.select("security_id", "canonical_id", "fiscal_year", "fiscal_month", F.when(~(both & (F.abs("amount") > times * near)), F.col("amount")).alias("amount"))


def expanding_median(spark, d):
    """The median of all earlier years' margin, for years without a usable one."""
    y = annual(wide(spark, d)).select("security_id", "fiscal_year", divide("NI", "SALE").alias("m"))
    w = Window.partitionBy("security_id").orderBy("fiscal_year").rowsBetween(Window.unboundedPreceding, -1)
    return y.select("security_id", "fiscal_year", F.round(F.percentile("m", 0.5).over(w), 8).alias("earlier_median"))


def bounded_accounts(spark, d):
    """Balances that exceed a multiple of total assets are left out."""
    w = wide(spark, d)
    return w.select("security_id", "fiscal_year", "fiscal_month", bounded("SEQ", "TA", 0.31).alias("SEQ"), bounded("LCT", "TA", 0.14).alias("LCT"), bounded("RE", "TA", 2.0).alias("RE"))


def last_periods(spark, d):
    """The last four trailing periods of each security."""
    w = Window.partitionBy("security_id").orderBy(F.desc("fiscal_year"), F.desc("fiscal_month"))
    return ttm(spark, d).withColumn("place", F.dense_rank().over(w)).where("place <= 4").select("security_id", "fiscal_year", "fiscal_month", "place", F.round("SALE", 4).alias("SALE"))


def effective_snapshot_date(spark, d):
    """For each quarter end the newest snapshot date on which all factors are present."""
    s = sc.snapshots(spark, d)
    full = s.groupBy("trade_date").agg(F.count_distinct("factor_id").alias("k")).where(f"k = {len(sc.IDS)}").select("trade_date")
    asked = full.groupBy(F.date_trunc("quarter", "trade_date").alias("q")).agg(F.max("trade_date").alias("effective_date"))
    return asked.select(F.last_day(F.add_months(F.to_date("q"), 2)).alias("as_of"), "effective_date")


def signal_snapshots(spark, d):
    """The newest snapshot at most 40 days before each signal, none with a later source; one row a signal."""
    s = sc.snapshots(spark, d).groupBy("trade_date").agg(F.max("source_trade_date").alias("last_source")).select(F.lit(0).alias("k"), "trade_date", "last_source")
    signals = rebalance_calendar(price_daily(spark, d)).select(F.lit(0).alias("k"), "signal_date")
    out = asof_join(signals, s.where("last_source <= trade_date"), ["k"], "signal_date", "trade_date", max_age=40)
    return out.select("signal_date", "trade_date", "last_source")


def coverage_gaps(spark, d):
    """Signals without a snapshot of every factor: a strict run fails on any."""
    have = bt._signals(spark, d).groupBy("signal_date").agg(F.count_distinct("factor_id").alias("k")).where(f"k = {len(sc.IDS)}")
    return rebalance_calendar(price_daily(spark, d)).select("segment_id", "signal_date").join(have, "signal_date", "left_anti")


def benchmark_nav(spark, d):
    """The index over its first value in the backtest, on the backtest's days."""
    days = bt._daily(spark, d).select("trade_date")
    i = days.join(benchmark(price_daily(spark, d)), "trade_date", "left")
    first = F.first("index_close", True).over(Window.partitionBy(F.lit(0)).orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0))
    return i.select("trade_date", F.round(divide("index_close", first), 8).alias("benchmark_nav"))


def official_consensus_events(spark, d):
    """A broker's values hold for 60 days; an empty event marks an expiry before the next value."""
    v = validity(reports(spark, d), ["security_id", "broker"], 60)
    w = Window.partitionBy("security_id", "broker").orderBy("report_date", "report_idx")
    nxt = F.lead("report_date").over(w)
    gone = F.when(nxt.isNull() | (nxt > F.col("valid_to")), F.struct(F.col("valid_to").alias("event_date"), F.lit(None).cast("double").alias("estimate")))
    rows = v.withColumn("e", F.array_compact(F.array(F.struct(F.col("report_date").alias("event_date"), "estimate"), gone)))
    return rows.select("security_id", "broker", F.explode("e").alias("e")).select("security_id", "broker", "e.*")


def target_window_choice(spark, d):
    """Of a day's last 30, 90, 365 days and all time, the first window with three analysts."""
    last = price_daily(spark, d).groupBy("security_id").agg(F.max("trade_date").alias("day"))
    r = reports(spark, d).join(last, "security_id").withColumn("age", F.datediff("day", "report_date")).where("age >= 0")
    names = {"month": 30, "quarter": 90, "year": 365, "all": 100000}
    g = r.groupBy("security_id").agg(*(F.count_distinct(F.when(F.col("age") <= n, F.col("analyst"))).alias(f"n_{k}") for k, n in names.items()), *(F.round(F.avg(F.when(F.col("age") <= n, F.col("estimate"))), 7).alias(f"m_{k}") for k, n in names.items()))
    pick = lambda p: F.coalesce(*(F.when(F.col(f"n_{k}") >= 3, F.lit(k) if p is None else F.col(f"{p}_{k}")) for k in names))
    return g.select("security_id", pick(None).alias("chosen"), pick("n").alias("n_analysts"), pick("m").alias("target"))


def next_trading_day(spark, d):
    """When a report becomes usable: the first trading day after it."""
    days = price_daily(spark, d).select("trade_date").distinct()
    series = Window.partitionBy(F.lit(0)).orderBy(F.desc("day"), F.desc("is_report")).rowsBetween(Window.unboundedPreceding, 0)
    both = days.select(F.col("trade_date").alias("day"), F.lit(0).alias("is_report"), F.col("trade_date").alias("t")).union(reports(spark, d).select("report_date").distinct().select("report_date", F.lit(1), F.lit(None).cast("date")))
    # on one day the report comes first in this order, so that the day itself does not count
    out = both.withColumn("available", F.last("t", True).over(series)).where("is_report = 1")
    return out.select(F.col("day").alias("report_date"), "available")


def score_validation(spark, d):
    """By factor: values, winsorized ones, low confidence, range of scores."""
    out = sc.scored(sc._valued(spark, d), group_least=5, sector_least=12, lower_better=["na_ratio"])
    return out.groupBy("factor_id").agg(F.count("*").alias("n"), F.count_if(F.col("winsorized") != F.col("factor_value")).alias("n_winsorized"), F.count_if(F.col("confidence") < 1).alias("n_low"), F.round(F.min("score"), 4).alias("lowest"), F.round(F.max("score"), 4).alias("highest"))


def missing_score_dates(spark, d):
    """Snapshot dates of the odd months that a score table of the even months lacks."""
    s = sc.snapshots(spark, d).select("trade_date").distinct()
    return s.join(s.where("month(trade_date) % 2 = 0"), "trade_date", "left_anti")


def sector_full_outer(spark, d):
    """Price and factor statistics of sectors side by side, also where one is missing."""
    m = security_master(spark, d)
    prices = price_daily(spark, d).join(m, "security_id").where("volume > 40").groupBy("sector").agg(F.count("*").alias("n_days"), F.max("close").alias("top"))
    facts = sc.snapshots(spark, d).where("factor_id = 'mom_1m' AND factor_value > 20").join(m, "security_id").groupBy("sector").agg(F.count("*").alias("n_high"))
    return prices.join(facts, "sector", "full_outer")


def country_risk(spark, d):
    """Sectors as countries: percentile of month volatility and of drawdown among the last 24 months, weighted."""
    p = price_daily(spark, d).join(security_master(spark, d).select("security_id", "sector"), "security_id")
    m = p.groupBy("sector", F.trunc("trade_date", "month").alias("month")).agg(F.round(F.stddev_samp("close") / F.avg("close"), 9).alias("vol"), F.round(F.min("close") / F.max("close") - 1, 9).alias("fall"))
    w = Window.partitionBy("sector").orderBy("month").rowsBetween(-23, 0)

    def place(c, worse):
        v = F.collect_list(c).over(w)
        return F.when(F.count(c).over(w) >= 12, F.size(F.filter(v, lambda x: x <= F.col(c) if worse == "high" else x >= F.col(c))) / F.size(v) * 100)

    return m.select("sector", "month", F.round(0.6 * place("vol", "high") + 0.4 * place("fall", "low"), 6).alias("risk"))


def regression_residuals(spark, d):
    """How far each security's 6-month return is from the day's line on volatility."""
    s = sc.snapshots(spark, d).groupBy("trade_date", "security_id").agg(*(F.max(F.when(F.col("factor_id") == f, F.col("factor_value"))).alias(f) for f in ("mom_1m", "high_gap"))).where("mom_1m IS NOT NULL AND high_gap IS NOT NULL")
    w = Window.partitionBy("trade_date")
    line = F.regr_intercept("mom_1m", "high_gap").over(w) + F.regr_slope("mom_1m", "high_gap").over(w) * F.col("high_gap")
    return s.select("trade_date", "security_id", F.round(F.when(F.count("*").over(w) >= 5, F.col("mom_1m") - line), 6).alias("residual"))


def estimate_variants(spark, d):
    """Next year's revenue three ways: by its trend, by the drivers, by their mean."""
    x = rq._drivers(spark, d).where("revenue_yoy IS NOT NULL")
    trend, driver = F.col("revenue") * (1 + F.col("revenue_yoy")), F.col("q") * (1 + F.col("q_yoy")) * F.col("asp") * (1 + F.col("asp_yoy"))
    base = x.withColumn("revenue", F.col("q") * F.col("asp"))
    rows = F.array(*(F.struct(F.lit(k).alias("model"), F.round(v, 2).alias("estimate")) for k, v in {"trend": trend, "driver": driver, "blend": (trend + driver) / 2}.items()))
    return base.select("p_brand", (F.col("year") + 1).alias("year"), F.explode(rows).alias("e")).select("p_brand", "year", "e.*")


def fact_candidates(spark, d):
    """Of several facts for one key the best source, then the newest filing."""
    o = read(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("fiscal_year"), F.to_date("o_orderdate").alias("filed"), F.substring("o_orderpriority", 1, 1).alias("source_rank"), "o_totalprice", "o_orderkey")
    w = Window.partitionBy("o_custkey", "fiscal_year").orderBy("source_rank", F.desc("filed"), F.desc("o_orderkey"))
    return o.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r", "o_orderkey")


def difference_diagnosis(spark, d):
    """Accounts whose amount is, within 2 %, a failed check's difference in the same filing."""
    bad = rq._checks(spark, d).where("status = 'FAIL' AND abs(difference) > 1000").select("security_id", "fiscal_year", "fiscal_month", "check_id", "difference")
    s = statements(spark, d).select("security_id", "fiscal_year", "fiscal_month", "canonical_id", "amount")
    near = F.abs(F.abs("difference") - F.abs("amount")) <= 0.02 * F.abs("difference")
    return bad.join(s, ["security_id", "fiscal_year", "fiscal_month"]).where(near).select("security_id", "fiscal_year", "fiscal_month", "check_id", "canonical_id")


PLAIN = (us_dividends, roe_three_years, neighbour_outliers, expanding_median, bounded_accounts, last_periods, effective_snapshot_date, signal_snapshots, coverage_gaps, benchmark_nav, official_consensus_events, target_window_choice, next_trading_day, score_validation, missing_score_dates, sector_full_outer, country_risk, regression_residuals, estimate_variants, fact_candidates, difference_diagnosis)
QUERIES = {f.__name__: f for f in PLAIN}

_WINDOWS = {"month": 30, "quarter": 90, "year": 365, "all": 100000}
_pick = lambda p: "CASE " + " ".join(f"WHEN n_{k} >= 3 THEN {repr(k) if p is None else f'{p}_{k}'}" for k in _WINDOWS) + " END"
SQL = {
    "us_dividends": sql("price_daily", "SELECT security_id, trade_date, coalesce(sum(paid) OVER (PARTITION BY security_id ORDER BY trade_date RANGE BETWEEN INTERVAL 364 DAY PRECEDING AND CURRENT ROW), 0) AS paid_365 FROM price_daily LEFT JOIN p USING (security_id, trade_date)", p="SELECT 'SEC_US_' || l_suppkey AS security_id, CAST(l_shipdate AS DATE) AS trade_date, sum(l_quantity) AS paid FROM lineitem WHERE l_returnflag = 'N' AND l_discount >= 0.09 GROUP BY 1, 2"),
    "roe_three_years": sql("statements", "SELECT security_id, fiscal_year, round(CASE WHEN count(roe) OVER f = 3 AND fiscal_year - lag(fiscal_year, 2) OVER w = 2 THEN avg(roe) OVER f END, 8) AS roe_3y FROM (SELECT *, NI / nullif(SEQ, 0) AS roe FROM wide WHERE fiscal_month = 12) WINDOW w AS (PARTITION BY security_id ORDER BY fiscal_year), f AS (PARTITION BY security_id ORDER BY fiscal_year ROWS 2 PRECEDING)", wide=PERIODS["wide"]),
    "neighbour_outliers": sql("statements", "SELECT security_id, canonical_id, fiscal_year, fiscal_month, CASE WHEN NOT (a IS NOT NULL AND b IS NOT NULL AND abs(amount) > 100 * greatest(abs(a), abs(b))) THEN amount END AS amount FROM (SELECT *, lag(amount) OVER w AS a, lead(amount) OVER w AS b FROM (SELECT * REPLACE (CASE WHEN canonical_id = 'INVT' AND fiscal_month = 9 THEN amount * 1000 ELSE amount END AS amount) FROM statements WHERE statement_type = 'BS') WINDOW w AS (PARTITION BY security_id, canonical_id ORDER BY fiscal_year, fiscal_month))"),
    "expanding_median": sql("statements", "SELECT security_id, fiscal_year, round(quantile_cont(m, 0.5) OVER (PARTITION BY security_id ORDER BY fiscal_year ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 8) AS earlier_median FROM (SELECT *, NI / nullif(SALE, 0) AS m FROM wide WHERE fiscal_month = 12)", wide=PERIODS["wide"]),
    "bounded_accounts": sql("statements", "SELECT security_id, fiscal_year, fiscal_month, CASE WHEN TA IS NULL OR abs(SEQ) <= 0.31 * abs(TA) THEN SEQ END AS SEQ, CASE WHEN TA IS NULL OR abs(LCT) <= 0.14 * abs(TA) THEN LCT END AS LCT, CASE WHEN TA IS NULL OR abs(RE) <= 2.0 * abs(TA) THEN RE END AS RE FROM wide", wide=PERIODS["wide"]),
    "last_periods": sql("statements", "SELECT security_id, fiscal_year, fiscal_month, CAST(place AS INTEGER) AS place, round(SALE, 4) AS SALE FROM (SELECT *, dense_rank() OVER (PARTITION BY security_id ORDER BY fiscal_year DESC, fiscal_month DESC) AS place FROM ttm) WHERE place <= 4", **PERIODS),
    "effective_snapshot_date": sql("price_daily", "SELECT last_day(CAST(date_trunc('quarter', trade_date) AS DATE) + INTERVAL 2 MONTH) AS as_of, max(trade_date) AS effective_date FROM (SELECT trade_date FROM snaps GROUP BY 1 HAVING count(DISTINCT factor_id) = 3) GROUP BY 1", **sc.FACTORS),
    "signal_snapshots": sql("price_daily", "SELECT c.signal_date, CASE WHEN c.signal_date - s.trade_date <= 40 THEN s.trade_date END AS trade_date, CASE WHEN c.signal_date - s.trade_date <= 40 THEN s.ls END AS last_source FROM cal c ASOF LEFT JOIN sx s ON c.signal_date >= s.trade_date", **sc.FACTORS, **bt.CAL, sx="SELECT trade_date, max(source_trade_date) AS ls FROM snaps GROUP BY 1 HAVING max(source_trade_date) <= trade_date"),
    "coverage_gaps": sql("price_daily", "SELECT segment_id, signal_date FROM cal WHERE signal_date NOT IN (SELECT signal_date FROM signals GROUP BY 1 HAVING count(DISTINCT factor_id) = 3)", **bt.SIG),
    "benchmark_nav": sql("price_daily benchmark_index", "SELECT trade_date, round(index_close / first_value(index_close) OVER (ORDER BY trade_date), 8) AS benchmark_nav FROM daily JOIN benchmark_index USING (trade_date)", **bt.DAILY),
    "official_consensus_events": sql("reports", "SELECT security_id, broker, report_date AS event_date, estimate FROM n UNION ALL SELECT security_id, broker, v, NULL FROM n WHERE nx IS NULL OR nx > v", n="SELECT *, least(coalesce(nx, report_date + 60), report_date + 60) AS v FROM (SELECT *, lead(report_date) OVER (PARTITION BY security_id, broker ORDER BY report_date, report_idx) AS nx FROM (SELECT * FROM reports QUALIFY row_number() OVER (PARTITION BY security_id, broker, report_date ORDER BY report_idx DESC) = 1))"),
    "target_window_choice": sql("price_daily reports", f"SELECT security_id, {_pick(None)} AS chosen, {_pick('n')} AS n_analysts, {_pick('m')} AS target FROM (SELECT security_id, {', '.join(f'count(DISTINCT CASE WHEN age <= {n} THEN analyst END) AS n_{k}, round(avg(CASE WHEN age <= {n} THEN estimate END), 7) AS m_{k}' for k, n in _WINDOWS.items())} FROM (SELECT r.*, day - report_date AS age FROM reports r JOIN (SELECT security_id, max(trade_date) AS day FROM price_daily GROUP BY 1) USING (security_id)) WHERE age >= 0 GROUP BY 1)"),
    "next_trading_day": sql("price_daily reports", "SELECT r.report_date, min(d.trade_date) AS available FROM (SELECT DISTINCT report_date FROM reports) r LEFT JOIN (SELECT DISTINCT trade_date FROM price_daily) d ON d.trade_date > r.report_date GROUP BY 1"),
    "score_validation": sql("price_daily security_master", "SELECT factor_id, count(*) AS n, count(*) FILTER (WHERE winsorized <> factor_value) AS n_winsorized, count(*) FILTER (WHERE n_peers < 5) AS n_low, round(min(score), 4) AS lowest, round(max(score), 4) AS highest FROM scored JOIN snaps USING (trade_date, security_id, factor_id) GROUP BY 1", **sc.SCORES),
    "missing_score_dates": sql("price_daily", "SELECT DISTINCT trade_date FROM snaps WHERE month(trade_date) % 2 = 1", **sc.FACTORS),
    "sector_full_outer": sql("price_daily security_master", "SELECT sector, n_days, top, n_high FROM (SELECT sector, count(*) AS n_days, max(close) AS top FROM price_daily JOIN security_master USING (security_id) WHERE volume > 40 GROUP BY 1) FULL JOIN (SELECT sector, count(*) AS n_high FROM snaps JOIN security_master USING (security_id) WHERE factor_id = 'mom_1m' AND factor_value > 20 GROUP BY 1) USING (sector)", **sc.FACTORS),
    "country_risk": sql("price_daily security_master", """SELECT sector, month, round(0.6 * pv + 0.4 * pf, 6) AS risk FROM (SELECT sector, month, CASE WHEN count(vol) OVER w >= 12 THEN len(list_filter(list(vol) FILTER (WHERE vol IS NOT NULL) OVER w, lambda x: x <= vol)) / count(vol) OVER w * 100 END AS pv,
        CASE WHEN count(fall) OVER w >= 12 THEN len(list_filter(list(fall) OVER w, lambda x: x >= fall)) / count(fall) OVER w * 100 END AS pf FROM m WINDOW w AS (PARTITION BY sector ORDER BY month ROWS 23 PRECEDING))""",
        m="SELECT sector, CAST(date_trunc('month', trade_date) AS DATE) AS month, round(stddev_samp(close) / avg(close), 9) AS vol, round(min(close) / max(close) - 1, 9) AS fall FROM price_daily JOIN security_master USING (security_id) GROUP BY 1, 2"),
    "regression_residuals": sql("price_daily", "SELECT trade_date, security_id, round(CASE WHEN count(*) OVER w >= 5 THEN y - (regr_intercept(y, x) OVER w + regr_slope(y, x) OVER w * x) END, 6) AS residual FROM (SELECT trade_date, security_id, max(CASE WHEN factor_id = 'mom_1m' THEN factor_value END) AS y, max(CASE WHEN factor_id = 'high_gap' THEN factor_value END) AS x FROM snaps GROUP BY 1, 2) WHERE x IS NOT NULL AND y IS NOT NULL WINDOW w AS (PARTITION BY trade_date)", **sc.FACTORS),
    "estimate_variants": f"WITH eco AS ({rq._ECO['eco']}), drv AS ({rq._ECO['drv']}), e AS (SELECT p_brand, year + 1 AS year, q * asp * (1 + revenue_yoy) AS t, q * (1 + q_yoy) * asp * (1 + asp_yoy) AS v FROM drv) SELECT p_brand, year, 'trend' AS model, round(t, 2) AS estimate FROM e UNION ALL SELECT p_brand, year, 'driver', round(v, 2) FROM e UNION ALL SELECT p_brand, year, 'blend', round((t + v) / 2, 2) FROM e",
    "fact_candidates": "SELECT o_custkey, CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, CAST(o_orderdate AS DATE) AS filed, substring(o_orderpriority, 1, 1) AS source_rank, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, year(o_orderdate) ORDER BY substring(o_orderpriority, 1, 1), CAST(o_orderdate AS DATE) DESC, o_orderkey DESC) = 1",
    "difference_diagnosis": sql("statements", "SELECT c.security_id, c.fiscal_year, c.fiscal_month, check_id, canonical_id FROM ck c JOIN statements s USING (security_id, fiscal_year, fiscal_month) WHERE status = 'FAIL' AND abs(difference) > 1000 AND abs(abs(difference) - abs(amount)) <= 0.02 * abs(difference)", **rq._CK),
}
