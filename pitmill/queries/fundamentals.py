"""Statements to ratios, scores, multiples, cost of capital, dividends."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import technical as t
from ..functions.semantics import divide
from ..operators import periods as p
from ..operators.asof import asof_join, asof_joins
from ..sources.views import FLOWS, ITEMS, price_daily, shares_monthly, sql, statements
from .fundamentals_sql import ratio_sql, valuation_sql

ALL = list(ITEMS)
LAGGED = ["SALE", "NI", "TA", "SEQ", "ACT", "LCT", "RECT", "INVT", "COGS", "SGA", "CFO", "DLTT", "DLC", "PPENT", "DP", "CHE"]

MARGINS = {"oi": "SALE - COGS - SGA", "gpm": "(SALE - COGS) / nullif(SALE, 0) * 100", "opm": "oi / nullif(SALE, 0) * 100", "ebitda_margin": "(oi + DP) / nullif(SALE, 0) * 100", "npm": "NI / nullif(SALE, 0) * 100", "fcf_margin": "(CFO - CAPX) / nullif(SALE, 0) * 100"}
RETURNS = {"oi": "SALE - COGS - SGA", "roe": "NI / nullif((SEQ + SEQ_l4) / 2, 0) * 100", "roa": "NI / nullif((TA + TA_l4) / 2, 0) * 100", "nopat": "oi * (1 - 0.21)", "invested": "TA - LCT - CHE", "roic": "nopat / CASE WHEN invested > 0 THEN invested END * 100", "accrual_ratio": "(NI - CFO) / nullif((TA + TA_l4) / 2, 0) * 100"}
EFFICIENCY = {"asset_turnover": "SALE / nullif((TA + TA_l4) / 2, 0)", "inventory_days": "INVT / nullif(COGS, 0) * 365", "receivable_days": "RECT / nullif(SALE, 0) * 365", "working_capital": "ACT - LCT", "ccc": "inventory_days + receivable_days"}
CASH = {"fcf": "CFO - CAPX", "cfo_to_ni": "CFO / CASE WHEN NI > 0 THEN NI END", "payout": "DIV / CASE WHEN NI > 0 THEN NI END * 100", "capex_to_sales": "CAPX / nullif(SALE, 0) * 100", "coverage": "CFO / nullif(XINT, 0)", "fcf_to_debt": "fcf / nullif(DLTT + DLC, 0)"}
GROWTH = {
    "sale_yoy": "(SALE / nullif(SALE_l4, 0) - 1) * 100", "ni_growth": "(NI - NI_l4) / nullif(abs(NI_l4), 0) * 100",
    "ni_profit_growth": "CASE WHEN (NI > 0 AND NI_l4 > 0) OR (NI < 0 AND NI_l4 < 0) THEN (NI - NI_l4) / abs(NI_l4) * 100 END",
    "asset_growth": "(TA / nullif(TA_l4, 0) - 1) * 100", "sale_cagr_3y": "CASE WHEN SALE > 0 AND SALE_l12 > 0 THEN (power(SALE / SALE_l12, 0.3333333333333333) - 1) * 100 END",
}
LEVERAGE = {"ebitda": "SALE - COGS - SGA + DP", "net_debt_to_ebitda": "(DLTT + DLC - CHE) / CASE WHEN ebitda > 0 THEN ebitda END", "icr": "(SALE - COGS - SGA) / nullif(XINT, 0)", "current_ratio": "ACT / nullif(LCT, 0)", "debt_to_equity": "(DLTT + DLC) / CASE WHEN SEQ > 0 THEN SEQ END", "cash_to_debt": "CHE / nullif(DLTT + DLC, 0)"}
ALTMAN = {"altman_base": "1.2 * (ACT - LCT) / nullif(TA, 0) + 1.4 * RE / nullif(TA, 0) + 3.3 * (SALE - COGS - SGA) / nullif(TA, 0) + 1.0 * SALE / nullif(TA, 0)"}
BENEISH = {
    "dsri": "RECT / nullif(SALE, 0) / nullif(RECT_l4 / nullif(SALE_l4, 0), 0)", "gmi": "(SALE_l4 - COGS_l4) / nullif(SALE_l4, 0) / nullif((SALE - COGS) / nullif(SALE, 0), 0)",
    "aqi": "(1 - (ACT + PPENT) / nullif(TA, 0)) / nullif(1 - (ACT_l4 + PPENT_l4) / nullif(TA_l4, 0), 0)", "sgi": "SALE / nullif(SALE_l4, 0)",
    "depi": "DP_l4 / nullif(DP_l4 + PPENT_l4, 0) / nullif(DP / nullif(DP + PPENT, 0), 0)", "sgai": "SGA / nullif(SALE, 0) / nullif(SGA_l4 / nullif(SALE_l4, 0), 0)",
    "tata": "(NI - CFO) / nullif(TA, 0)", "lvgi": "(DLTT + DLC) / nullif(TA, 0) / nullif((DLTT_l4 + DLC_l4) / nullif(TA_l4, 0), 0)",
    "m_score": "-4.84 + 0.92 * dsri + 0.528 * gmi + 0.404 * aqi + 0.892 * sgi + 0.115 * depi - 0.172 * sgai + 4.679 * tata - 0.327 * lvgi",
}
#: A test that cannot be made counts 0.
PIOTROSKI_TESTS = ["NI > 0", "CFO > 0", "NI / nullif(TA, 0) > NI_l4 / nullif(TA_l4, 0)", "CFO > NI", "DLTT / nullif(TA, 0) < DLTT_l4 / nullif(TA_l4, 0)", "ACT / nullif(LCT, 0) > ACT_l4 / nullif(LCT_l4, 0)", "SEQ <= SEQ_l4", "(SALE - COGS) / nullif(SALE, 0) > (SALE_l4 - COGS_l4) / nullif(SALE_l4, 0)", "SALE / nullif(TA, 0) > SALE_l4 / nullif(TA_l4, 0)"]
PIOTROSKI = {"f_score": " + ".join(f"CASE WHEN {x} THEN 1 ELSE 0 END" for x in PIOTROSKI_TESTS)}


def wide(spark, d):
    return p.wide_statements(statements(spark, d), ALL)


def ttm(spark, d):
    return p.trailing(p.single_quarters(wide(spark, d), FLOWS), FLOWS)


def statement_wide(spark, d):
    return wide(spark, d)


def quarter_ttm(spark, d):
    quarter = p.single_quarters(wide(spark, d), FLOWS)
    both = quarter.select(*p.KEY, *(F.col(c).alias(f"{c}_q") for c in FLOWS)).join(p.trailing(quarter, FLOWS).select(*p.KEY, *(F.col(c).alias(f"{c}_ttm") for c in FLOWS)), p.KEY)
    return both.select(*p.KEY, *(F.round(c, 4).alias(c) for c in both.columns if c not in p.KEY))


def annual_select(spark, d):
    return p.annual(wide(spark, d)).select(*p.KEY, "SALE", "NI", "TA", "report_date")


def _ratios(formulas, lags=(4,)):
    def query(spark, d):
        frame = p.with_formulas(p.with_lags(ttm(spark, d), LAGGED, list(lags)), formulas)
        return frame.select(*p.KEY, *formulas)

    def text():
        inner = "SELECT *, " + ", ".join(f"lag({c}, {k}) OVER (PARTITION BY security_id ORDER BY fiscal_year, fiscal_month) AS {c}_l{k}" for c in LAGGED for k in lags) + " FROM ttm"
        for name, expression in formulas.items():
            inner = f"SELECT *, {expression} AS {name} FROM ({inner})"
        return sql("statements", f"SELECT security_id, fiscal_year, fiscal_month, {', '.join(f'round({n}, 6) AS {n}' for n in formulas)} FROM ({inner})", **PERIODS)

    return query, text


_cases = ", ".join(f"max(CASE WHEN canonical_id = '{c}' THEN amount END) AS \"{c}\"" for c in ALL)
_quarter = ", ".join(f"{c} - CASE WHEN row_number() OVER y = 1 THEN 0 ELSE lag({c}) OVER y END AS {c}" for c in FLOWS)
_rest = ", ".join(c for c in ALL if c not in FLOWS)
PERIODS = {
    "wide": f"SELECT security_id, fiscal_year, fiscal_month, max(report_date) AS report_date, {_cases} FROM statements GROUP BY 1, 2, 3",
    "single": f"SELECT security_id, fiscal_year, fiscal_month, report_date, {_rest}, {_quarter} FROM wide WINDOW y AS (PARTITION BY security_id, fiscal_year ORDER BY fiscal_month)",
    "ttm": f"SELECT security_id, fiscal_year, fiscal_month, report_date, {_rest}, {', '.join(f'CASE WHEN count({c}) OVER w = 4 THEN sum({c}) OVER w END AS {c}' for c in FLOWS)} FROM single WINDOW w AS (PARTITION BY security_id ORDER BY fiscal_year, fiscal_month ROWS 3 PRECEDING)",
}
RATIOS = {
    "annual_margins": _ratios(MARGINS), "returns_on_capital": _ratios(RETURNS), "efficiency": _ratios(EFFICIENCY), "cashflow_payout": _ratios(CASH), "growth_suite": _ratios(GROWTH, (4, 12)),
    "leverage": _ratios(LEVERAGE), "altman": _ratios(ALTMAN), "beneish": _ratios(BENEISH), "piotroski": _ratios(PIOTROSKI),
}

# --- daily valuation --------------------------------------------------------------------------

VALUATION = {
    "mcap": "close * shares", "eps": "NI / CASE WHEN shares > 0 THEN shares END", "bps": "SEQ / CASE WHEN shares > 0 THEN shares END",
    "per": "close / CASE WHEN eps > 0 THEN eps END", "pbr": "close / CASE WHEN bps > 0 THEN bps END", "psr": "mcap / CASE WHEN SALE > 0 THEN SALE END", "pcr": "mcap / CASE WHEN CFO > 0 THEN CFO END",
    "dividend_yield": "DIV / CASE WHEN mcap > 0 THEN mcap END * 100", "ev": "mcap + DLTT + DLC - CHE", "ev_to_ebitda": "ev / CASE WHEN SALE - COGS - SGA + DP > 0 THEN SALE - COGS - SGA + DP END",
    "ev_flag": "CASE WHEN mcap IS NULL THEN 'no_market_cap' WHEN ev IS NULL THEN 'no_statement' WHEN ev <= 0 THEN 'negative_ev' ELSE 'ok' END",
}
DAY = ["security_id", "trade_date"]


def daily_statements(spark, d, carried=("close",)):
    """Prices with the shares and the trailing statement known on each day; one pass over the days."""
    prices = price_daily(spark, d).select(*DAY, *carried)
    reported = ttm(spark, d).select("security_id", "report_date", "fiscal_year", "fiscal_month", *ALL)
    return asof_joins(prices, ["security_id"], "trade_date", [(shares_monthly(price_daily(spark, d)), "known_date"), (reported, "report_date")]).drop("known_date")


DAILY = {
    "daily_shares": "SELECT p.security_id, p.trade_date, p.close, s.shares FROM price_daily p ASOF LEFT JOIN shares_monthly s ON p.security_id = s.security_id AND p.trade_date >= s.known_date",
    "daily": f"SELECT p.*, s.report_date, s.fiscal_year, s.fiscal_month, {', '.join(f's.{c}' for c in ALL)} FROM daily_shares p ASOF LEFT JOIN ttm s ON p.security_id = s.security_id AND p.trade_date >= s.report_date",
}


def asof_statements(spark, d):
    return daily_statements(spark, d).select(*DAY, "fiscal_year", "fiscal_month", "report_date", F.round("NI", 4).alias("NI"), "SEQ")


def multiple_columns():
    return {n: F.round(n, 9) if n != "ev_flag" else F.col(n) for n in VALUATION if n not in ("mcap", "ev")}


def valuation_multiples(spark, d):
    frame = p.with_formulas(daily_statements(spark, d), VALUATION, None)
    return frame.select(*DAY, *(c.alias(n) for n, c in multiple_columns().items()))


def _valuation_sql(select):
    inner = "SELECT * FROM daily"
    for name, text in VALUATION.items():
        inner = f"SELECT *, {text} AS {name} FROM ({inner})"
    return sql("statements price_daily shares_monthly", select.format(inner=inner), **PERIODS, **DAILY)


#: Residual income with fading returns: B + B (ROE - r) d / (1 - d + r), for 0 < r < 1 and a positive target.
RIM = {"roe": "NI / CASE WHEN SEQ > 0 THEN SEQ END", "r": "0.085", "bps": "SEQ / CASE WHEN shares > 0 THEN shares END", "target": "bps + bps * (roe - r) * 0.8 / (1 - 0.8 + r)", "rim_upside": "CASE WHEN target > 0 THEN (target / nullif(close, 0) - 1) * 100 END"}


def rim_upside(spark, d):
    return p.with_formulas(daily_statements(spark, d), RIM, None).select(*DAY, F.round("rim_upside", 6).alias("rim_upside"))


def with_duration(frame):
    """``frame`` (with per) and equity_duration: growing cash flows of 19 years and a terminal value at year 20; kept within (0, 20]."""
    r = F.lit(0.085)
    g = r - divide(F.lit(1.0), F.col("per"))
    x = (1 + g) / (1 + r)
    flow = divide(F.lit(1.0), F.col("per")) / (1 + r)
    parts = F.aggregate(F.sequence(F.lit(1), F.lit(19)), F.struct(F.lit(0.0).alias("pv"), F.lit(0.0).alias("t")), lambda s, k: F.struct((s["pv"] + flow * F.pow(x, k - 1)).alias("pv"), (s["t"] + k * flow * F.pow(x, k - 1)).alias("t")))
    out = frame.withColumn("_parts", F.when(flow.isNotNull() & x.isNotNull(), parts))  # a fold over the years, made once a day; its fields count as never null
    out = out.withColumn("_years", (F.col("_parts.t") + 20 * (1 - F.col("_parts.pv"))) / (1 + r))
    return out.withColumn("equity_duration", F.round(F.when((F.col("_years") > 0) & (F.col("_years") <= 20), F.col("_years")), 6)).drop("_parts", "_years")


def equity_duration(spark, d):
    return with_duration(p.with_formulas(daily_statements(spark, d), {k: VALUATION[k] for k in ("eps", "per")}, None)).select(*DAY, "equity_duration")


_DURATION = """SELECT security_id, trade_date, round(CASE WHEN v > 0 AND v <= 20 THEN v END, 6) AS equity_duration FROM (
    SELECT security_id, trade_date, (list_sum(list_transform(range(1, 20), lambda k: k * f * power(x, k - 1))) + 20 * (1 - list_sum(list_transform(range(1, 20), lambda k: f * power(x, k - 1))))) / 1.085 AS v
    FROM (SELECT *, 1 / per / 1.085 AS f, (1 + 0.085 - 1 / per) / 1.085 AS x FROM ({inner})))"""

# --- dividends ----------------------------------------------------------------------------------


def yearly_dividends(spark, d):
    frame = p.annual(wide(spark, d)).join(shares_monthly(price_daily(spark, d)).groupBy("security_id").agg(F.max_by("shares", "known_date").alias("shares")), "security_id")
    return frame.select("security_id", "fiscal_year", "report_date", F.round(F.when(F.col("DIV") > 150000, F.col("DIV")).otherwise(0.0) / F.col("shares"), 6).alias("dps"))


_YEARLY = {
    "last_shares": "SELECT security_id, max_by(shares, known_date) AS shares FROM shares_monthly GROUP BY 1",
    "yearly": "SELECT w.security_id, fiscal_year, report_date, round(CASE WHEN DIV > 150000 THEN DIV ELSE 0.0 END / shares, 6) AS dps FROM wide w JOIN last_shares USING (security_id) WHERE fiscal_month = 12",
}


def by_year():
    return Window.partitionBy("security_id").orderBy("fiscal_year")


def dividend_asof(spark, d):
    """Yield of each day by the dividend known then."""
    frame = asof_join(price_daily(spark, d).select(*DAY, "close"), yearly_dividends(spark, d).drop("fiscal_year"), ["security_id"], "trade_date", "report_date")
    return frame.select(*DAY, "dps", F.round(divide("dps", "close") * 100, 6).alias("dividend_yield"))


def dividend_streaks(spark, d):
    """Consecutive years with a dividend, and with a growing one: islands between breaks."""
    y = yearly_dividends(spark, d).withColumn("before", F.lag("dps").over(by_year()))
    for name, good in (("paid", F.col("dps") > 0), ("grew", F.coalesce(F.col("dps") > F.col("before"), F.lit(False)))):
        island = f"_{name}"
        y = y.withColumn(island, F.sum(F.when(good, 0).otherwise(1)).over(by_year().rowsBetween(Window.unboundedPreceding, 0)))
        w = Window.partitionBy("security_id", island).orderBy("fiscal_year").rowsBetween(Window.unboundedPreceding, 0)
        y = y.withColumn(f"{name}_years", F.sum(F.when(good, 1).otherwise(0)).over(w))
    return y.select("security_id", "fiscal_year", "dps", "paid_years", "grew_years")


def dividend_growth(spark, d):
    y = yearly_dividends(spark, d).withColumn("b1", F.lag("dps", 1).over(by_year())).withColumn("b3", F.lag("dps", 3).over(by_year()))
    w = by_year().rowsBetween(-4, 0)
    growth = F.when(F.col("b1") > 0, (F.col("dps") / F.col("b1") - 1) * 100)
    cagr = F.when((F.col("dps") > 0) & (F.col("b3") > 0), (F.pow(F.col("dps") / F.col("b3"), F.lit(1 / 3)) - 1) * 100)
    return y.select("security_id", "fiscal_year", F.round(growth, 6).alias("dps_yoy"), F.round(cagr, 6).alias("dps_cagr_3y"), (F.col("dps") < F.col("b1")).alias("cut"), F.round(F.when(F.count("dps").over(w) >= 3, F.stddev_samp("dps").over(w)), 6).alias("dps_volatility"))


# --- repairs and tables ---------------------------------------------------------------------------


def unit_scale_repair(spark, d):
    """One published period a security is a thousand times too large in this input; it is found and divided."""
    long = statements(spark, d).where("canonical_id IN ('TA', 'SEQ', 'ACT', 'LCT')").select(*p.KEY, "canonical_id", "amount")
    broken = long.withColumn("amount", F.when((F.col("fiscal_year") == 1997) & (F.col("fiscal_month") == 6), F.col("amount") * 1000).otherwise(F.col("amount")))
    return p.repair_scale(broken).select(*p.KEY, "canonical_id", F.round("amount", 2).alias("amount"), "scaled_by")


IDENTITIES = [("LT", "TA - SEQ"), ("LLT", "LT - LCT"), ("GP", "SALE - COGS"), ("OI", "GP - SGA"), ("PRETAX", "OI - XINT")]


def derived_accounts(spark, d):
    frame = wide(spark, d).withColumns({a: F.lit(None).cast("double") for a, _ in IDENTITIES})
    return p.derive_missing(frame, IDENTITIES).select(*p.KEY, *(F.round(a, 2).alias(a) for a, _ in IDENTITIES))


def statement_table(spark, d):
    """Latest, highest, lowest, mean of each account, and its change over a year."""
    long = statements(spark, d).where("fiscal_month = 12").withColumn("before", F.lag("amount").over(Window.partitionBy("security_id", "canonical_id").orderBy("fiscal_year")))
    return long.groupBy("security_id", "canonical_id").agg(F.max_by("amount", "fiscal_year").alias("latest"), F.max("amount").alias("highest"), F.min("amount").alias("lowest"), F.round(F.avg("amount"), 2).alias("mean"), F.round(F.max_by(F.try_divide(F.col("amount") - F.col("before"), F.abs("before")), "fiscal_year") * 100, 6).alias("change"))


def ratio_history(spark, d):
    """The last value of a ratio within each fiscal period it belongs to."""
    frame = p.with_formulas(daily_statements(spark, d), {"eps": VALUATION["eps"], "per": VALUATION["per"]}, None).where("per IS NOT NULL")
    return frame.groupBy("security_id", "fiscal_year", "fiscal_month").agg(F.round(F.max_by("per", "trade_date"), 6).alias("per"), F.max("trade_date").alias("as_of"))


PLAIN = (statement_wide, quarter_ttm, annual_select, asof_statements, valuation_multiples, rim_upside, equity_duration, dividend_asof, dividend_streaks, dividend_growth, unit_scale_repair, derived_accounts, statement_table, ratio_history)
QUERIES = {f.__name__: f for f in PLAIN} | {name: query for name, (query, _) in RATIOS.items()}


def _chain(base, formulas):
    for name, text in formulas.items():
        base = f"SELECT *, {text} AS {name} FROM ({base})"
    return base


_V = "statements price_daily shares_monthly"
_Y = "OVER (PARTITION BY security_id ORDER BY fiscal_year"
SQL = {name: text() for name, (_, text) in RATIOS.items()} | {
    "statement_wide": sql("statements", "SELECT * FROM wide", **PERIODS),
    "quarter_ttm": sql("statements", f"SELECT s.security_id, s.fiscal_year, s.fiscal_month, {', '.join(f'round(s.{c}, 4) AS {c}_q, round(t.{c}, 4) AS {c}_ttm' for c in FLOWS)} FROM single s JOIN ttm t USING (security_id, fiscal_year, fiscal_month)", **PERIODS),
    "annual_select": sql("statements", "SELECT security_id, fiscal_year, fiscal_month, SALE, NI, TA, report_date FROM wide WHERE fiscal_month = 12", **PERIODS),
    "asof_statements": sql(_V, "SELECT security_id, trade_date, fiscal_year, fiscal_month, report_date, round(NI, 4) AS NI, SEQ FROM daily", **PERIODS, **DAILY),
    "valuation_multiples": _valuation_sql("SELECT security_id, trade_date, " + ", ".join(f"round({n}, 9) AS {n}" for n in VALUATION if n not in ("mcap", "ev", "ev_flag")) + ", ev_flag FROM ({inner})"),
    "rim_upside": sql(_V, f"SELECT security_id, trade_date, round(rim_upside, 6) AS rim_upside FROM ({_chain('SELECT * FROM daily', RIM)})", **PERIODS, **DAILY),
    "equity_duration": sql(_V, _DURATION.format(inner=_chain("SELECT * FROM daily", {"eps": VALUATION["eps"], "per": VALUATION["per"]})), **PERIODS, **DAILY),
    "dividend_asof": sql(_V, "SELECT p.security_id, p.trade_date, y.dps, round(y.dps / p.close * 100, 6) AS dividend_yield FROM price_daily p ASOF LEFT JOIN yearly y ON p.security_id = y.security_id AND p.trade_date >= y.report_date", **PERIODS, **_YEARLY),
    "dividend_streaks": sql(_V, f"""SELECT security_id, fiscal_year, dps, sum(CASE WHEN dps > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY security_id, i ORDER BY fiscal_year) AS paid_years,
        sum(CASE WHEN dps > b THEN 1 ELSE 0 END) OVER (PARTITION BY security_id, j ORDER BY fiscal_year) AS grew_years FROM (
        SELECT *, sum(CASE WHEN dps > 0 THEN 0 ELSE 1 END) {_Y}) AS i, sum(CASE WHEN dps > b THEN 0 ELSE 1 END) {_Y}) AS j FROM (SELECT *, lag(dps) {_Y}) AS b FROM yearly))""", **PERIODS, **_YEARLY),
    "dividend_growth": sql(_V, f"""SELECT security_id, fiscal_year, round(CASE WHEN b1 > 0 THEN (dps / b1 - 1) * 100 END, 6) AS dps_yoy, round(CASE WHEN dps > 0 AND b3 > 0 THEN (power(dps / b3, 1.0::DOUBLE / 3) - 1) * 100 END, 6) AS dps_cagr_3y,
        dps < b1 AS cut, round(CASE WHEN count(dps) {_Y} ROWS 4 PRECEDING) >= 3 THEN stddev_samp(dps) {_Y} ROWS 4 PRECEDING) END, 6) AS dps_volatility FROM (SELECT *, lag(dps, 1) {_Y}) AS b1, lag(dps, 3) {_Y}) AS b3 FROM yearly)""", **PERIODS, **_YEARLY),
    "unit_scale_repair": sql("statements", "SELECT b.security_id, b.fiscal_year, b.fiscal_month, canonical_id, round(amount / coalesce(s, 1.0), 2) AS amount, coalesce(s, 1.0) AS scaled_by FROM b LEFT JOIN v USING (security_id, fiscal_year, fiscal_month)",
        b="SELECT security_id, fiscal_year, fiscal_month, canonical_id, amount * CASE WHEN fiscal_year = 1997 AND fiscal_month = 6 THEN 1000.0 ELSE 1.0 END AS amount FROM statements WHERE canonical_id IN ('TA', 'SEQ', 'ACT', 'LCT')",
        m="SELECT *, abs(amount) / nullif(greatest(abs(lag(amount) OVER w), abs(lead(amount) OVER w)), 0) AS o FROM b WINDOW w AS (PARTITION BY security_id, canonical_id ORDER BY fiscal_year, fiscal_month)",
        v="SELECT security_id, fiscal_year, fiscal_month, min(CASE WHEN o > 1e5 THEN 1e6 WHEN o > 100 THEN 1e3 END)::DOUBLE AS s FROM m GROUP BY 1, 2, 3 HAVING count(CASE WHEN o > 100 THEN 1 END) >= greatest(3, 0.25 * count(amount))"),
    "derived_accounts": sql("statements", f"SELECT security_id, fiscal_year, fiscal_month, {', '.join(f'round({a}, 2) AS {a}' for a, _ in IDENTITIES)} FROM ({_chain('SELECT * FROM wide', dict(IDENTITIES))})", **PERIODS),
    "statement_table": sql("statements", """SELECT security_id, canonical_id, max_by(amount, fiscal_year) AS latest, max(amount) AS highest, min(amount) AS lowest, round(avg(amount), 2) AS mean,
        round(arg_max_null((amount - b) / nullif(abs(b), 0), fiscal_year) * 100, 6) AS change FROM (SELECT *, lag(amount) OVER (PARTITION BY security_id, canonical_id ORDER BY fiscal_year) AS b FROM statements WHERE fiscal_month = 12) GROUP BY 1, 2"""),
    "ratio_history": sql(_V, f"SELECT security_id, fiscal_year, fiscal_month, round(max_by(per, trade_date), 6) AS per, max(trade_date) AS as_of FROM ({_chain('SELECT * FROM daily', {'eps': VALUATION['eps'], 'per': VALUATION['per']})}) WHERE per IS NOT NULL GROUP BY 1, 2, 3", **PERIODS, **DAILY),
}
SQL |= ratio_sql(PERIODS) | {"valuation_multiples": valuation_sql(PERIODS, DAILY)}
