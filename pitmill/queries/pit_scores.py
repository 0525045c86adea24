"""Point-in-time choices and scores: bases, validity, per-factor winsorizing, style and total scores with their parts, estimates with expiry."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.semantics import divide
from ..operators import consensus as c
from ..operators import screening as s
from ..operators.asof import asof_join
from ..sources.views import price_daily, read, reports, security_master, sql
from .feeds import RATES, risk_free_rates
from .scoring import PM, SCORES, VALUED, _valued, snapshots
from .scoring import FACTORS as _FACTORS


def asof_risk_free(spark, d):
    """The rate of a security's market that was known on each day."""
    days = price_daily(spark, d).join(security_master(spark, d).select("security_id", F.col("sector").alias("market")), "security_id").select("market", "trade_date").distinct()
    return asof_join(days, risk_free_rates(spark, d), ["market"], "trade_date", "rate_date").select("market", "trade_date", "rate_date", "rate")


def _forward(spark, d):
    """Reports as estimates of the year's end that lies ahead, or of the next one."""
    r = reports(spark, d)
    year = F.year("report_date") + F.when(F.col("report_idx") % 2 == 0, 0).otherwise(1)
    return r.select("security_id", F.lit("EPS").alias("metric_id"), F.make_date(year, F.lit(12), F.lit(31)).alias("target_end"), F.col("report_date").alias("as_of_date"), F.col("estimate").alias("consensus_mean"), "report_idx")


def asof_stale_forward(spark, d):
    """For each day the nearest target period that has not ended, by its newest estimate of at most 180 days."""
    e = _forward(spark, d).groupBy("security_id", "metric_id", "target_end", "as_of_date").agg(F.max_by("consensus_mean", "report_idx").alias("consensus_mean"))
    return c.nearest_future(price_daily(spark, d).select("security_id", "trade_date"), e, 180)


def estimate_history(spark, d):
    """Estimates of one metric between two days for target periods from a year on."""
    e = _forward(spark, d).withColumnRenamed("consensus_mean", "estimate_value")
    return c.estimate_history(e, "EPS", "1996-03-01", "1998-06-30", "1997-12-31").select("security_id", "target_end", "as_of_date", "report_idx", "estimate_value")


def revisions_by_lookback(spark, d):
    """Revision of an estimate against the newest one at least 7, 30, 60, 90 days older, of the same fiscal end; and acceleration."""
    e = _forward(spark, d).groupBy("security_id", "target_end", "as_of_date").agg(F.max_by("consensus_mean", "report_idx").alias("value"))
    out = c.lookback_revisions(e, ["security_id", "target_end"], "as_of_date", "value", [7, 30, 60, 90])
    return out.select("security_id", "target_end", "as_of_date", *(F.round(f"rev_{k}", 6).alias(f"rev_{k}") for k in (7, 30, 60, 90)), F.round("acceleration", 6).alias("acceleration"))


ORDER = ["B0", "B3", "B1", "B6"]


def strict_targets(spark, d):
    """The target of the first provider in strict order whose newest event is positive and of three analysts."""
    ev = reports(spark, d).groupBy("security_id", F.col("broker").alias("provider"), F.last_day("report_date").alias("factor_date")).agg(F.round(F.avg("estimate"), 6).alias("target"), F.count_distinct("analyst").alias("analyst_count"))
    days = price_daily(spark, d).select("security_id", F.last_day("trade_date").alias("factor_date")).distinct()
    return c.strict_targets(days, ev, ORDER, 3)


def implied_surprise(spark, d):
    """Operating income implied by consensus EPS against what was disclosed."""
    from .fundamentals import ttm

    x = ttm(spark, d).select("security_id", "fiscal_year", "fiscal_month", (F.col("SALE") - F.col("COGS") - F.col("SGA")).alias("oi"), F.col("NI").alias("ni"), (F.col("TA") / 1000).alias("shares"))
    x = x.withColumn("eps", F.when(F.col("fiscal_month") != 6, divide("ni", "shares") * (1 + 0.01 * F.col("fiscal_month"))))
    return x.select("security_id", "fiscal_year", "fiscal_month", F.round(c.implied_surprise("eps", "shares", "ni", "oi"), 5).alias("surprise"))


def _bases(spark, d):
    """Month-end factor values under several bases and versions."""
    v = snapshots(spark, d).where("factor_id <> 'high_gap'")
    basis = F.explode(F.array(F.when(F.month("trade_date") % 3 == 0, F.lit("quarterly")), F.when(F.month("trade_date") % 2 == 0, F.lit("annual")), F.when(F.dayofmonth("trade_date") % 2 == 0, F.lit("ttm")), F.lit("forward")))
    return v.drop("source_trade_date").withColumn("financial_basis", basis).where("financial_basis IS NOT NULL").withColumn("updated_at", F.col("trade_date"))


def basis_fallback(spark, d):
    """One row a factor: ttm before annual before quarterly before others."""
    return s.basis_fallback(_bases(spark, d), ["trade_date", "security_id", "factor_id"]).select("trade_date", "security_id", "factor_id", "financial_basis", "factor_value")


LIMITS = [("mom_1m", -0.2, 0.2), ("na_ratio", -0.1, 0.1)]


def _marked(spark, d):
    v = snapshots(spark, d).withColumn("factor_value", F.when((F.col("factor_id") == "high_gap") & (F.dayofmonth("trade_date") == 30), F.lit(None)).when((F.col("factor_id") == "high_gap") & (F.dayofmonth("trade_date") == 29), F.lit(float("inf"))).otherwise(F.col("factor_value")))
    return s.mark_validity(v, spark.createDataFrame(LIMITS, "factor_id string, lower double, upper double"))


def validity_marks(spark, d):
    """Missing, non-finite and out-of-range values by factor and day; the last stay valid."""
    return _marked(spark, d).groupBy("trade_date", "factor_id", "invalid_reason").agg(F.count("*").alias("n"), F.count_if("is_valid").alias("n_valid"), F.count_if("is_missing").alias("n_missing"))


def winsorized_by_factor(spark, d):
    """Values kept between quantiles that depend on the factor: 1 and 99 % for prices, 5 and 95 % for the others, within the sector."""
    q = spark.createDataFrame([("mom_1m", 0.05, 0.95), ("high_gap", 0.01, 0.99)], "factor_id string, low_q double, high_q double")
    out = s.winsorize_by_factor(_valued(spark, d), ["trade_date", "factor_id", "sector"], q, (0.1, 0.9))
    return out.select("trade_date", "security_id", "factor_id", F.round("winsorized", 10).alias("winsorized"), "is_winsorized")


def _scores(spark, d, last_only=False):
    """Scores of all month ends, or of the last alone: a day's scores depend on no other day's."""
    return s.factor_scores(_valued(spark, d, last_only), group_least=5, sector_least=12, lower_better=["na_ratio"]).select("trade_date", "security_id", "factor_id", "score")


W = [("value", "na_ratio", 0.5), ("value", "high_gap", 0.5), ("consensus", "mom_1m", 0.6), ("consensus", "na_ratio", 0.4), ("lowvol", "missing_one", 0.5), ("lowvol", "high_gap", 0.5)]


def style_detail(spark, d):
    """Style scores with core factors, without which a style has no score, and the ids that are missing or invalid."""
    marks = _marked(spark, d).select("trade_date", "security_id", "factor_id", "is_valid")
    return s.style_detail(_scores(spark, d), marks, spark.createDataFrame(W, "style string, factor_id string, weight double"), {"consensus": ["mom_1m", "na_ratio"]}).select("trade_date", "security_id", "style", F.round("score", 4).alias("score"), F.round("confidence", 4).alias("confidence"), "missing", "invalid")


def score_list(spark, d):
    """The ten best totals of the last day, with the number of all."""
    return s.top_k(_totals(spark, d), "total", 10)


def _totals(spark, d):
    return _scores(spark, d, last_only=True).groupBy("trade_date", "security_id").agg(F.round(F.avg("score"), 4).alias("total"))


def score_breakdown(spark, d):
    """Each factor's part in its style's score on the last day."""
    return s.breakdown(_scores(spark, d, last_only=True), spark.createDataFrame(W, "style string, factor_id string, weight double")).select("security_id", "style", "factor_id", F.round("score", 4).alias("score"), F.round("share", 6).alias("share"), F.round("part", 4).alias("part"))


def factors_and_styles(spark, d):
    """Long factors and style scores as one table of factors."""
    f = snapshots(spark, d).select("trade_date", "security_id", "factor_id", "factor_value")
    st = s.weighted_scores(_scores(spark, d), spark.createDataFrame(W, "style string, factor_id string, weight double"))
    both = f.unionByName(st.select("trade_date", "security_id", F.concat(F.lit("style_"), "style").alias("factor_id"), F.col("score").alias("factor_value")))
    return both.groupBy("trade_date", "factor_id").agg(F.count("*").alias("n"), F.round(F.avg("factor_value"), 4).alias("mean"))


def screen_filtered(spark, d):
    """Classification filters and alias names, in order of value with NULLs last, and the total count beside the rows."""
    ids = s.canonical_ids(["MOM/1M", "Δna_ratio"], {"mom/1m": "mom_1m", "dna_ratio": "na_ratio"})
    v = _valued(spark, d, last_only=True).where(F.col("factor_id").isin(ids) & F.col("sector").isin("ASIA", "EUROPE") & F.startswith("security_id", F.lit("SEC_US_")))
    wide = v.groupBy("security_id", "industry_group").agg(F.max(F.when(F.col("factor_id") == "mom_1m", F.col("factor_value"))).alias("mom_1m"), F.max(F.when(F.col("factor_id") == "na_ratio", F.col("factor_value"))).alias("na_ratio"))
    return s.placed(wide.withColumn("mom_1m", F.when(F.col("mom_1m") > -0.2, F.col("mom_1m"))), [F.desc_nulls_last("mom_1m"), F.asc("industry_group"), F.asc("security_id")])


def rnd_imputed(spark, d):
    """Missing research costs are zero in sectors where firms have none, if there are operating data."""
    from .fundamentals import wide

    w = wide(spark, d).join(security_master(spark, d).select("security_id", "sector"), "security_id").select("security_id", "fiscal_year", "fiscal_month", "sector", F.when(F.col("fiscal_month") == 12, F.col("SGA")).alias("XRD"), F.when(F.col("fiscal_month") != 3, F.col("SALE")).alias("SALE"), F.when(F.col("fiscal_month") != 3, F.col("NI")).alias("OI"))
    xrd, flag = s.impute_zero("XRD", F.col("sector"), ["ASIA", "EUROPE", "AFRICA"], ["AFRICA"], ["SALE", "OI"])
    return w.select("security_id", "fiscal_year", "fiscal_month", F.round(xrd, 4).alias("XRD"), flag.alias("imputed"))


def peer_premium(spark, d):
    """Annualised return of each market's index over two years, less its latest rate."""
    p = price_daily(spark, d).join(security_master(spark, d).select("security_id", F.col("sector").alias("market")), "security_id").groupBy("market", "trade_date").agg(F.avg("close").alias("close"))
    rates = risk_free_rates(spark, d).groupBy("market").agg(F.max_by("rate", "rate_date").alias("rate"))
    return s.index_premium(p, rates, 2.0).select("market", F.round("expected", 5).alias("expected"), F.round("premium", 5).alias("premium"))


def universe_filtered(spark, d):
    """Listed common shares only, with floors by country."""
    rows = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.upper("p_name").alias("name"), (F.col("p_size") % 5 != 0).alias("is_active"), F.when(F.col("p_partkey") % 9 == 0, "ETF").when(F.col("p_partkey") % 11 == 0, "REIT").otherwise("STOCK").alias("asset_subtype"), F.when(F.col("p_partkey") % 4 == 0, "PREFERRED").otherwise("COMMON").alias("share_class"), F.when(F.col("p_partkey") % 2 == 0, "KR").otherwise("US").alias("country"), F.col("p_retailprice").alias("mcap"), (F.col("p_retailprice") * F.col("p_size")).alias("traded"))
    return s.eligible(rows, ["ETF", "SPAC", "REIT"], ["COMMON"], spark.createDataFrame([("KR", 905.0, 2000.0), ("US", 902.0, 3000.0)], "country string, least_mcap double, least_traded double")).select("id", "country")


QUERIES = {q.__name__: q for q in (asof_risk_free, asof_stale_forward, estimate_history, revisions_by_lookback, strict_targets, implied_surprise, basis_fallback, validity_marks, winsorized_by_factor, style_detail, score_list, score_breakdown, factors_and_styles, screen_filtered, rnd_imputed, peer_premium, universe_filtered)}

_FWD = "SELECT security_id, make_date(CAST(year(report_date) + report_idx % 2 AS INTEGER), 12, 31) AS target_end, report_date AS as_of_date, estimate AS v, report_idx FROM reports"
_ONE = "SELECT security_id, target_end, as_of_date, max_by(v, report_idx) AS v FROM fwd GROUP BY 1, 2, 3"
_BACK = lambda k: f"(SELECT max_by(o.v, o.as_of_date) FROM one o WHERE o.security_id = e.security_id AND o.target_end = e.target_end AND o.as_of_date <= e.as_of_date - {k})"
_MARKS = VALUED | {
    "raw": "SELECT * REPLACE (CASE WHEN factor_id = 'high_gap' AND day(trade_date) = 30 THEN NULL WHEN factor_id = 'high_gap' AND day(trade_date) = 29 THEN 'inf'::DOUBLE ELSE factor_value END AS factor_value) FROM snaps",
    "marks": """SELECT *, factor_value IS NULL AS is_missing, factor_value IS NOT NULL AND isfinite(factor_value) AS is_valid, CASE WHEN factor_value IS NULL THEN 'MISSING' WHEN factor_id = 'mom_1m' AND abs(factor_value) > 0.2 OR factor_id = 'na_ratio' AND abs(factor_value) > 0.1 THEN 'OUT_OF_RANGE' WHEN NOT isfinite(factor_value) THEN 'NON_FINITE' ELSE '' END AS invalid_reason FROM raw""",
}
_W = "SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {x}::DOUBLE)" for a, b, x in W) + ") t(style, factor_id, weight)"
_LAST = "trade_date = (SELECT max(trade_date) FROM scored)"
SQL = {
    "asof_risk_free": sql("price_daily security_master", "SELECT dd.market, dd.trade_date, r.rate_date, r.rate FROM (SELECT DISTINCT sector AS market, trade_date FROM price_daily JOIN security_master USING (security_id)) dd ASOF LEFT JOIN rf r ON dd.market = r.market AND dd.trade_date >= r.rate_date", rf=RATES),
    "asof_stale_forward": sql("price_daily reports", """SELECT p.security_id, p.trade_date, x.target_end, x.v AS estimate FROM price_daily p LEFT JOIN (SELECT p.security_id, p.trade_date, o.target_end, o.v FROM price_daily p JOIN (SELECT *, lead(as_of_date) OVER (PARTITION BY security_id, target_end ORDER BY as_of_date) AS nx FROM one) o
        ON p.security_id = o.security_id AND o.as_of_date <= p.trade_date AND (nx IS NULL OR nx > p.trade_date) AND p.trade_date - o.as_of_date <= 180 AND o.target_end >= p.trade_date QUALIFY row_number() OVER (PARTITION BY p.security_id, p.trade_date ORDER BY o.target_end) = 1) x USING (security_id, trade_date)""", fwd=_FWD, one=_ONE),
    "estimate_history": sql("reports", "SELECT security_id, target_end, as_of_date, report_idx, v AS estimate_value FROM fwd WHERE as_of_date BETWEEN DATE '1996-03-01' AND DATE '1998-06-30' AND target_end >= DATE '1997-12-31'", fwd=_FWD),
    "revisions_by_lookback": sql("reports", "SELECT security_id, target_end, as_of_date, " + ", ".join(f"round(100 * (v - b{k}) / greatest(abs(b{k}), 0.1), 6) AS rev_{k}" for k in (7, 30, 60, 90)) + ", round(100 * (v - b30) / greatest(abs(b30), 0.1) - 100 * (b30 - b90) / greatest(abs(b90), 0.1) / 2, 6) AS acceleration FROM (SELECT *, " + ", ".join(f"{_BACK(k)} AS b{k}" for k in (7, 30, 60, 90)) + " FROM one e)", fwd=_FWD, one=_ONE),
    "strict_targets": sql("price_daily reports", f"""SELECT dd.security_id, dd.factor_date, x.provider, x.target FROM dd LEFT JOIN (SELECT security_id, factor_date, provider, target FROM (SELECT dd.security_id, dd.factor_date, ev.provider, ev.target, ev.n, row_number() OVER (PARTITION BY dd.security_id, dd.factor_date, ev.provider ORDER BY ev.factor_date DESC) AS r
        FROM dd JOIN ev ON dd.security_id = ev.security_id AND ev.factor_date <= dd.factor_date) WHERE r = 1 AND n >= 3 AND target > 0 AND provider IN ({', '.join(repr(x) for x in ORDER)}) QUALIFY row_number() OVER (PARTITION BY security_id, factor_date ORDER BY list_position([{', '.join(repr(x) for x in ORDER)}], provider)) = 1) x USING (security_id, factor_date)""",
        dd="SELECT DISTINCT security_id, last_day(trade_date) AS factor_date FROM price_daily", ev="SELECT security_id, broker AS provider, last_day(report_date) AS factor_date, round(avg(estimate), 6) AS target, count(DISTINCT analyst) AS n FROM reports GROUP BY 1, 2, 3"),
    "basis_fallback": sql("price_daily", "SELECT trade_date, security_id, factor_id, CASE WHEN day(trade_date) % 2 = 0 THEN 'ttm' WHEN month(trade_date) % 2 = 0 THEN 'annual' WHEN month(trade_date) % 3 = 0 THEN 'quarterly' ELSE 'forward' END AS financial_basis, factor_value FROM snaps WHERE factor_id <> 'high_gap'", **_FACTORS),
    "validity_marks": sql(PM, "SELECT trade_date, factor_id, invalid_reason, count(*) AS n, count(*) FILTER (WHERE is_valid) AS n_valid, count(*) FILTER (WHERE is_missing) AS n_missing FROM marks GROUP BY 1, 2, 3", **_MARKS),
    "winsorized_by_factor": sql(PM, """SELECT trade_date, security_id, factor_id, round(greatest(lo, least(hi, factor_value)), 10) AS winsorized, factor_value < lo OR factor_value > hi AS is_winsorized FROM valued JOIN (SELECT trade_date, factor_id, sector,
        CASE factor_id WHEN 'mom_1m' THEN quantile_cont(factor_value, 0.05) WHEN 'high_gap' THEN quantile_cont(factor_value, 0.01) ELSE quantile_cont(factor_value, 0.1) END AS lo, CASE factor_id WHEN 'mom_1m' THEN quantile_cont(factor_value, 0.95) WHEN 'high_gap' THEN quantile_cont(factor_value, 0.99) ELSE quantile_cont(factor_value, 0.9) END AS hi FROM valued GROUP BY 1, 2, 3) USING (trade_date, factor_id, sector)""", **VALUED),
    "style_detail": sql(PM, """SELECT trade_date, security_id, style, CASE WHEN style = 'consensus' AND n < 2 THEN NULL ELSE round(score, 4) END AS score, round(confidence, 4) AS confidence, missing, invalid FROM (
        SELECT trade_date, security_id, style, count(score) AS n, sum(weight * score) / sum(CASE WHEN score IS NOT NULL THEN weight END) AS score, coalesce(sum(CASE WHEN score IS NOT NULL THEN weight END), 0) / sum(weight) AS confidence,
        coalesce(string_agg(factor_id, ',' ORDER BY factor_id) FILTER (WHERE score IS NULL), '') AS missing, coalesce(string_agg(factor_id, ',' ORDER BY factor_id) FILTER (WHERE is_valid = false), '') AS invalid
        FROM (SELECT DISTINCT trade_date, security_id FROM scored) CROSS JOIN w LEFT JOIN scored USING (trade_date, security_id, factor_id) LEFT JOIN marks USING (trade_date, security_id, factor_id) GROUP BY 1, 2, 3)""", **SCORES, **{k: _MARKS[k] for k in ("raw", "marks")}, w=_W),
    "score_list": sql(PM, f"SELECT CAST(row_number() OVER (ORDER BY total DESC, security_id) AS INTEGER) AS rank, security_id, total, (SELECT count(DISTINCT security_id) FROM scored WHERE {_LAST}) AS n_all FROM (SELECT security_id, round(avg(score), 4) AS total FROM scored WHERE {_LAST} GROUP BY 1) ORDER BY total DESC, security_id LIMIT 10", **SCORES),
    "score_breakdown": sql(PM, f"SELECT security_id, style, factor_id, round(score, 4) AS score, round(weight / sum(weight) OVER (PARTITION BY security_id, style), 6) AS share, round(score * weight / sum(weight) OVER (PARTITION BY security_id, style), 4) AS part FROM scored JOIN w USING (factor_id) WHERE {_LAST}", **SCORES, w=_W),
    "factors_and_styles": sql(PM, "SELECT trade_date, factor_id, count(*) AS n, round(avg(v), 4) AS mean FROM (SELECT trade_date, factor_id, factor_value AS v FROM snaps UNION ALL SELECT trade_date, 'style_' || style, sum(weight * score) / sum(weight) FROM scored JOIN w USING (factor_id) GROUP BY trade_date, security_id, style) GROUP BY 1, 2", **SCORES, w=_W),
    "screen_filtered": sql(PM, """SELECT security_id, industry_group, mom_1m, na_ratio, CAST(row_number() OVER (ORDER BY mom_1m DESC NULLS LAST, industry_group, security_id) AS INTEGER) AS place, count(*) OVER () AS n_all FROM (SELECT security_id, industry_group, max(CASE WHEN factor_id = 'mom_1m' AND factor_value > -0.2 THEN factor_value END) AS mom_1m, max(CASE WHEN factor_id = 'na_ratio' THEN factor_value END) AS na_ratio
        FROM valued WHERE sector IN ('ASIA', 'EUROPE') AND factor_id IN ('mom_1m', 'na_ratio') AND trade_date = (SELECT max(trade_date) FROM valued WHERE sector IN ('ASIA', 'EUROPE') AND factor_id IN ('mom_1m', 'na_ratio')) GROUP BY 1, 2)""", **VALUED),
    "universe_filtered": "SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'KR' ELSE 'US' END AS country FROM part WHERE p_size % 5 <> 0 AND p_partkey % 9 <> 0 AND p_partkey % 11 <> 0 AND p_partkey % 4 <> 0 AND CASE WHEN p_partkey % 2 = 0 THEN p_retailprice >= 905 AND p_retailprice * p_size >= 2000 ELSE p_retailprice >= 902 AND p_retailprice * p_size >= 3000 END",
    "peer_premium": sql("price_daily security_master", """SELECT market, round(e, 5) AS expected, round(e - rate, 5) AS premium FROM (SELECT market, (power(max_by(c, trade_date) / min_by(c, trade_date), 1 / (date_diff('day', min(trade_date), max(trade_date)) / 365.25)) - 1) * 100 AS e FROM (SELECT *, max(trade_date) OVER (PARTITION BY market) AS l FROM
        (SELECT sector AS market, trade_date, avg(close) AS c FROM price_daily JOIN security_master USING (security_id) GROUP BY 1, 2)) WHERE trade_date >= l - 730 GROUP BY 1) JOIN (SELECT market, max_by(rate, rate_date) AS rate FROM rf GROUP BY 1) USING (market)""", rf=RATES),
}
_WIDE = "SELECT security_id, fiscal_year, fiscal_month, max(CASE WHEN canonical_id = 'SGA' THEN amount END) AS sga, max(CASE WHEN canonical_id = 'SALE' THEN amount END) AS sale FROM statements GROUP BY 1, 2, 3"
SQL["rnd_imputed"] = sql("statements security_master", "SELECT security_id, fiscal_year, fiscal_month, round(CASE WHEN fiscal_month = 12 THEN sga WHEN i THEN 0 END, 4) AS XRD, i AS imputed FROM (SELECT *, fiscal_month NOT IN (3, 12) AND sector IN ('ASIA', 'EUROPE') AS i FROM w JOIN security_master USING (security_id))", w=_WIDE)
from .fundamentals import PERIODS as _TTM  # noqa: E402

SQL["implied_surprise"] = sql("statements", """SELECT security_id, fiscal_year, fiscal_month, round(CASE WHEN ni > 0 AND oi > 0 AND shares > 0 AND fiscal_month <> 6 THEN (oi * (ni / shares * (1 + 0.01 * fiscal_month) * shares) / ni - oi) / abs(oi) * 100 END, 5) AS surprise FROM (SELECT *, SALE - COGS - SGA AS oi, NI AS ni, TA / 1000 AS shares FROM ttm)""", **_TTM)
