"""Snapshots, universe, scores, screens, valuation bands, sector leaders."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import technical as t
from ..functions.cross_section import quantile_exact
from ..functions.semantics import divide
from ..operators.asof import carry_forward, month_ends, snapshot
from ..operators.screening import factor_scores as scored
from ..operators.screening import screen, weighted_scores
from ..sources.views import melted, price_daily, security_master, shares_monthly, sql, trading_days
from .market import _GAP, _lag, _ma

IDS = ["mom_1m", "high_gap", "na_ratio"]


def factors(spark, d):
    """Three daily factors, long."""
    wide = price_daily(spark, d).select("security_id", "trade_date", F.round(t.momentum(F.col("close"), 0, 21), 6).alias("mom_1m"), F.round(t.high_gap(F.col("close")), 6).alias("high_gap"), F.round(divide(F.col("close"), t.moving_average(F.col("close"), 20)) - 1, 6).alias("na_ratio"))
    return melted(wide, ["security_id", "trade_date"], IDS, "factor_id", "factor_value").where("factor_value IS NOT NULL")


def snapshots(spark, d, max_age=None, last_only=False):
    days = trading_days(spark, d)
    dates = days.agg(F.max("trade_date").alias("trade_date")) if last_only else month_ends(days)
    return snapshot(factors(spark, d), dates, ["security_id", "factor_id"], max_age=max_age)


def snapshot_month_end(spark, d):
    return snapshots(spark, d).select("trade_date", "security_id", "factor_id", "factor_value", "source_trade_date")


def snapshot_backfill(spark, d):
    """Only values of at most 14 days' age."""
    return snapshots(spark, d, 14).select("trade_date", "security_id", "factor_id", "factor_value", "source_trade_date")


def snapshot_incremental(spark, d):
    """The last day's rows over the snapshot of the day before."""
    f = factors(spark, d)
    last = f.agg(F.max("trade_date").alias("trade_date"))
    before = f.join(F.broadcast(last.withColumnRenamed("trade_date", "_l")), F.col("trade_date") < F.col("_l"))
    day_before = before.agg(F.max("trade_date").alias("trade_date"))
    previous = snapshot(before.drop("_l"), day_before, ["security_id", "factor_id"])
    today = f.join(F.broadcast(last), "trade_date").withColumn("source_trade_date", F.col("trade_date"))
    out = carry_forward(today, previous, ["security_id", "factor_id"])
    return out.crossJoin(F.broadcast(last.withColumnRenamed("trade_date", "snapshot_date"))).select("snapshot_date", "security_id", "factor_id", "factor_value", "source_trade_date")


def universe(spark, d):
    """Active securities above floors of size and of 20-row traded value, on each security's last day. The mean is of whole hundredths, so that it is the same in any order of addition."""
    w = t.rows(t.security_days(), 20)
    hundredths = F.round(F.col("close") * F.col("volume") * 100).cast("long")
    p = price_daily(spark, d).withColumn("traded", F.struct(F.sum(hundredths).over(w).alias("total"), (F.count(hundredths).over(w) * 100).alias("n")))
    last = p.groupBy("security_id").agg(F.max_by(F.struct("close", "traded"), "trade_date").alias("x"))
    shares = shares_monthly(price_daily(spark, d)).groupBy("security_id").agg(F.max_by("shares", "known_date").alias("shares"))
    out = security_master(spark, d).where("is_active").join(last, "security_id").join(shares, "security_id").withColumn("mcap", F.col("x.close") * F.col("shares"))
    return out.where((F.col("mcap") >= 100000) & (F.col("x.traded.total") >= 5000 * F.col("x.traded.n"))).select("security_id", "industry_group", "sector", "is_financial", F.floor("mcap").alias("mcap"), F.expr("x.traded.total div x.traded.n").alias("traded"))


def _valued(spark, d, last_only=False):
    return snapshots(spark, d, last_only=last_only).join(security_master(spark, d), "security_id")


def factor_scores(spark, d):
    out = scored(_valued(spark, d), group_least=5, sector_least=12, lower_better=["na_ratio"])
    return out.select("trade_date", "security_id", "factor_id", "level", "peer_code", "n_peers", F.round("winsorized", 10).alias("winsorized"), F.round("score", 4).alias("score"), F.round("robust_z", 4).alias("robust_z"), "confidence")


WEIGHTS = [("momentum", "mom_1m", 0.6), ("momentum", "high_gap", 0.4), ("reversal", "na_ratio", 0.7), ("reversal", "mom_1m", 0.3)]


def _styles(spark, d):
    scores = scored(_valued(spark, d), group_least=5, sector_least=12, lower_better=["na_ratio"]).select("trade_date", "security_id", "factor_id", "score")
    return weighted_scores(scores, spark.createDataFrame(WEIGHTS, "style string, factor_id string, weight double"))


def style_scores(spark, d):
    return _styles(spark, d).select("trade_date", "security_id", "style", F.round("score", 4).alias("score"), F.round("confidence", 4).alias("confidence"), "missing")


def total_scores(spark, d):
    """Profile weights over styles, renormalised over those at hand."""
    profile = spark.createDataFrame([("momentum", 0.7), ("reversal", 0.3)], "style string, w double")
    s = _styles(spark, d).join(F.broadcast(profile), "style")
    return s.groupBy("trade_date", "security_id").agg(F.round(divide(F.sum(F.col("w") * F.col("score")), F.sum("w")), 4).alias("total_score"), F.count("*").alias("n_styles"))


def industry_snapshot(spark, d):
    v = _valued(spark, d)
    return v.groupBy("trade_date", "industry_group", "factor_id").agg(
        F.count("factor_value").alias("n"), F.round(F.avg("factor_value"), 10).alias("mean"),
        *(F.round(F.percentile("factor_value", q), 10).alias(f"p{int(q * 100)}") for q in (0.1, 0.25, 0.5, 0.75, 0.9)),
    )


def screen_top_percent(spark, d):
    top = screen(snapshots(spark, d), [{"factor_id": "mom_1m", "op": "top_percent", "value": 20}])
    return top.join(security_master(spark, d).select("security_id", "name", "sector"), "security_id").select("trade_date", "security_id", "name", "sector", "n_matched", F.col("value_0").alias("mom_1m"))


ANY = [{"factor_id": "mom_1m", "op": ">", "value": 0.5}, {"factor_id": "high_gap", "op": "between", "value": [-0.2, 0.0]}]
MIXED = [{"factor_id": "mom_1m", "op": "top_percent", "value": 40}, {"factor_id": "na_ratio", "op": "top_percent", "value": 60, "high": False}, {"factor_id": "high_gap", "op": "<", "value": -0.1}]


def screen_threshold_any(spark, d):
    return screen(snapshots(spark, d), ANY, match_all=False)


def screen_mixed_all(spark, d):
    return screen(snapshots(spark, d), MIXED)


def bands_history(spark, d):
    """Quartiles of a security's own month-end values."""
    rows = snapshots(spark, d).where("factor_id = 'high_gap'")
    return rows.groupBy("security_id").agg(F.count("*").alias("n_months"), *(F.round(F.percentile("factor_value", q), 10).alias(f"p{int(q * 100)}") for q in (0.25, 0.5, 0.75)))


def bands_market(spark, d):
    """Mean of a day's values kept between exact 5 % and 95 % quantiles, by sector."""
    rows = _valued(spark, d)
    bounds = quantile_exact(rows, ["trade_date", "factor_id", "sector"], "factor_value", {"low": 0.05, "high": 0.95})
    kept = rows.join(bounds, ["trade_date", "factor_id", "sector"]).withColumn("v", F.greatest("low", F.least("high", "factor_value")))
    return kept.groupBy("trade_date", "factor_id", "sector").agg(F.count("*").alias("n"), F.round(F.avg("v"), 10).alias("winsorized_mean"), F.max("low").alias("low"), F.max("high").alias("high"))


def bands_blend(spark, d):
    """Target price ratio as the median of own history, sector and market, with bands and a signal at 5 %."""
    p = price_daily(spark, d)
    last = p.groupBy("security_id").agg(F.max_by("close", "trade_date").alias("close"), F.round(F.percentile("close", 0.5), 6).alias("own"))
    rows = last.join(security_master(spark, d).select("security_id", "sector"), "security_id")
    sector = rows.groupBy("sector").agg(F.round(F.percentile("close", 0.5), 6).alias("of_sector"))
    market = rows.agg(F.round(F.percentile("close", 0.5), 6).alias("of_market"))
    out = rows.join(F.broadcast(sector), "sector").crossJoin(F.broadcast(market)).withColumn("target", F.array_sort(F.array("own", "of_sector", "of_market"))[1])
    gap = divide("target", "close") - 1
    signal = F.when(gap > 0.05, "undervalued").when(gap < -0.05, "overvalued").otherwise("neutral")
    return out.select("security_id", "close", "target", F.round(F.col("target") * 0.9, 6).alias("buy_below"), F.round(F.col("target") * 1.1, 6).alias("sell_above"), signal.alias("signal"))


def sector_leaders(spark, d):
    """By sector: members, mean month return, share near their 52-week high."""
    p = price_daily(spark, d)
    w = t.security_days()
    p = p.withColumn("r21", t.momentum(F.col("close"), 0, 21)).withColumn("near", F.col("close") >= 0.9 * F.max("high").over(t.rows(w, 252)))
    last = p.groupBy("security_id").agg(F.max_by(F.struct("r21", "near"), "trade_date").alias("x")).join(security_master(spark, d), "security_id")
    return last.groupBy("sector").agg(F.count("*").alias("n"), F.round(F.avg("x.r21"), 5).alias("mean_return"), F.round(F.avg(F.col("x.near").cast("double")), 5).alias("strong_share"))


QUERIES = {f.__name__: f for f in (snapshot_month_end, snapshot_backfill, snapshot_incremental, universe, factor_scores, style_scores, total_scores, industry_snapshot, screen_top_percent, screen_threshold_any, screen_mixed_all, bands_history, bands_market, bands_blend, sector_leaders)}

FACTORS = {
    "wide_f": f"SELECT security_id, trade_date, round(close / {_lag(21)} - 1, 6) AS mom_1m, round({_GAP}, 6) AS high_gap, round(close / ({_ma(20)}) - 1, 6) AS na_ratio FROM price_daily",
    "factors": "SELECT * FROM (UNPIVOT wide_f ON mom_1m, high_gap, na_ratio INTO NAME factor_id VALUE factor_value)",
    "ends": "SELECT max(trade_date) AS d FROM price_daily GROUP BY date_trunc('month', trade_date)",
    "spine": "SELECT security_id, factor_id, d FROM (SELECT security_id, factor_id, min(trade_date) AS f FROM factors GROUP BY 1, 2), ends WHERE d >= f",
    "snaps": "SELECT s.d AS trade_date, s.security_id, s.factor_id, f.factor_value, f.trade_date AS source_trade_date FROM spine s ASOF JOIN factors f ON s.security_id = f.security_id AND s.factor_id = f.factor_id AND s.d >= f.trade_date",
}
VALUED = FACTORS | {"valued": "SELECT s.*, m.industry_group, m.sector, m.is_financial FROM snaps s JOIN security_master m USING (security_id)"}
_BY = "trade_date, factor_id, lvl, code"
SCORES = VALUED | {
    "lev": """SELECT *, CASE WHEN is_financial THEN 'financial' WHEN count(*) OVER (PARTITION BY trade_date, factor_id, is_financial, industry_group) >= 5 THEN 'group'
        WHEN count(*) OVER (PARTITION BY trade_date, factor_id, is_financial, sector) >= 12 THEN 'sector' ELSE 'all' END AS level FROM valued""",
    "laid": """SELECT *, 'financial' AS lvl, 'financial' AS code FROM lev WHERE is_financial UNION ALL SELECT *, 'group', industry_group FROM lev WHERE NOT is_financial
        UNION ALL SELECT *, 'sector', sector FROM lev WHERE NOT is_financial UNION ALL SELECT *, 'all', 'all' FROM lev WHERE NOT is_financial""",
    "win": f"SELECT *, greatest(lo, least(hi, factor_value)) AS winsorized FROM laid JOIN (SELECT {_BY}, quantile_cont(factor_value, 0.05) AS lo, quantile_cont(factor_value, 0.95) AS hi, count(factor_value) AS n_peers FROM laid GROUP BY ALL) USING ({_BY})",
    "med": f"SELECT *, abs(winsorized - median) AS off FROM win JOIN (SELECT {_BY}, quantile_cont(winsorized, 0.5) AS median FROM win GROUP BY ALL) USING ({_BY})",
    "ranked": f"""SELECT *, CASE WHEN factor_id = 'na_ratio' THEN -winsorized ELSE winsorized END AS turned FROM med JOIN (SELECT {_BY}, quantile_cont(off, 0.5) AS mad FROM med GROUP BY ALL) USING ({_BY})""",
    "scored": f"""SELECT trade_date, security_id, factor_id, level, code AS peer_code, n_peers, winsorized, median, mad, CASE WHEN n = 1 THEN 100.0 ELSE (r + (k - 1) / 2.0 - 1) / (n - 1) * 100 END AS score FROM (
        SELECT *, rank() OVER (PARTITION BY {_BY} ORDER BY turned) AS r, count(*) OVER (PARTITION BY {_BY}, turned) AS k, count(*) OVER (PARTITION BY {_BY}) AS n FROM ranked) WHERE lvl = level""",
}
_W = " UNION ALL ".join(f"SELECT '{s}' AS style, '{f}' AS factor_id, {w}::DOUBLE AS weight" for s, f, w in WEIGHTS)
STYLES = SCORES | {
    "weights": _W,
    "styles": """SELECT trade_date, security_id, style, sum(weight * score) / sum(weight) AS score, sum(weight) / any_value(t) AS confidence,
        array_to_string(list_sort(list_filter(any_value(every), lambda x: NOT list_contains(list(factor_id), x))), ',') AS missing FROM scored JOIN weights USING (factor_id)
        JOIN (SELECT style, sum(weight) AS t, list(factor_id) AS every FROM weights GROUP BY 1) USING (style) GROUP BY 1, 2, 3""",
}
_TOP = "row_number() OVER (PARTITION BY trade_date ORDER BY factor_value {o}, security_id) <= greatest(1, ceil(count(*) OVER (PARTITION BY trade_date) * {p} / 100.0))"
_CONDITIONS = lambda tests: " UNION ALL ".join(f"SELECT trade_date, security_id, {k} AS k, factor_value AS v, {x} AS met FROM snaps WHERE factor_id = '{f}'" for k, (f, x) in enumerate(tests))
_SCREEN = "SELECT trade_date, security_id, sum(met::INT) AS n_matched, {v} FROM c GROUP BY 1, 2 HAVING sum(met::INT) >= {n}"
_values = lambda n: ", ".join(f"max(CASE WHEN k = {i} THEN v END) AS value_{i}" for i in range(n))
P, PM = "price_daily", "price_daily security_master"
SQL = {
    "snapshot_month_end": sql(P, "SELECT * FROM snaps", **FACTORS),
    "snapshot_backfill": sql(P, "SELECT * FROM snaps WHERE trade_date - source_trade_date <= 14", **FACTORS),
    "snapshot_incremental": sql(P, "SELECT (SELECT max(trade_date) FROM factors) AS snapshot_date, security_id, factor_id, max_by(factor_value, trade_date) AS factor_value, max(trade_date) AS source_trade_date FROM factors GROUP BY security_id, factor_id", **{k: FACTORS[k] for k in ("wide_f", "factors")}),
    "universe": sql("price_daily security_master shares_monthly", """SELECT security_id, industry_group, sector, is_financial, CAST(floor(c * shares) AS BIGINT) AS mcap, CAST(total // n AS BIGINT) AS traded FROM security_master JOIN (
        SELECT security_id, max_by(close, trade_date) AS c, max_by(t, trade_date) AS total, max_by(k, trade_date) * 100 AS n FROM (SELECT *, sum(h) OVER w AS t, count(h) OVER w AS k FROM (SELECT *, CAST(round(close * volume * 100) AS BIGINT) AS h FROM price_daily) WINDOW w AS (PARTITION BY security_id ORDER BY trade_date ROWS 19 PRECEDING)) GROUP BY 1) USING (security_id)
        JOIN (SELECT security_id, max_by(shares, known_date) AS shares FROM shares_monthly GROUP BY 1) USING (security_id) WHERE is_active AND c * shares >= 100000 AND total >= 5000 * n"""),
    "factor_scores": sql(PM, """SELECT trade_date, security_id, factor_id, level, peer_code, n_peers, round(winsorized, 10) AS winsorized, round(score, 4) AS score,
        round(greatest(-3.0, least(3.0, CASE WHEN mad = 0 THEN 0.0 ELSE 0.6745 * (winsorized - median) / mad END)), 4) AS robust_z, CASE WHEN n_peers < 5 THEN 0.25 ELSE 1.0 END::DOUBLE AS confidence FROM scored""", **SCORES),
    "style_scores": sql(PM, "SELECT trade_date, security_id, style, round(score, 4) AS score, round(confidence, 4) AS confidence, missing FROM styles", **STYLES),
    "total_scores": sql(PM, "SELECT trade_date, security_id, round(sum(w * score) / sum(w), 4) AS total_score, count(*) AS n_styles FROM (SELECT *, CASE style WHEN 'momentum' THEN 0.7::DOUBLE ELSE 0.3::DOUBLE END AS w FROM styles) GROUP BY 1, 2", **STYLES),
    "industry_snapshot": sql(PM, "SELECT trade_date, industry_group, factor_id, count(factor_value) AS n, round(avg(factor_value), 10) AS mean, " + ", ".join(f"round(quantile_cont(factor_value, {q}), 10) AS p{int(q * 100)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9)) + " FROM valued GROUP BY 1, 2, 3", **VALUED),
    "screen_top_percent": sql(PM, f"SELECT trade_date, security_id, name, sector, 1::BIGINT AS n_matched, factor_value AS mom_1m FROM (SELECT *, {_TOP.format(o='DESC', p=20)} AS met FROM snaps WHERE factor_id = 'mom_1m') JOIN security_master USING (security_id) WHERE met", **FACTORS),
    "screen_threshold_any": sql(P, _SCREEN.format(v=_values(2), n=1), **FACTORS, c=_CONDITIONS([("mom_1m", "factor_value > 0.5"), ("high_gap", "factor_value BETWEEN -0.2 AND 0.0")])),
    "screen_mixed_all": sql(P, _SCREEN.format(v=_values(3), n=3), **FACTORS, c=_CONDITIONS([("mom_1m", _TOP.format(o="DESC", p=40)), ("na_ratio", _TOP.format(o="ASC", p=60)), ("high_gap", "factor_value < -0.1")])),
    "bands_history": sql(P, "SELECT security_id, count(*) AS n_months, " + ", ".join(f"round(quantile_cont(factor_value, {q}), 10) AS p{int(q * 100)}" for q in (0.25, 0.5, 0.75)) + " FROM snaps WHERE factor_id = 'high_gap' GROUP BY 1", **FACTORS),
    "bands_market": sql(PM, """SELECT trade_date, factor_id, sector, count(*) AS n, round(avg(greatest(low, least(high, factor_value))), 10) AS winsorized_mean, max(low) AS low, max(high) AS high FROM valued JOIN (
        SELECT trade_date, factor_id, sector, list_sort(list(factor_value))[CAST(least(count(*), floor(count(*) * 0.05) + 1) AS BIGINT)] AS low, list_sort(list(factor_value))[CAST(least(count(*), floor(count(*) * 0.95) + 1) AS BIGINT)] AS high FROM valued GROUP BY 1, 2, 3) USING (trade_date, factor_id, sector) GROUP BY 1, 2, 3""", **VALUED),
    "bands_blend": sql(PM, """SELECT security_id, close, target, round(target * 0.9, 6) AS buy_below, round(target * 1.1, 6) AS sell_above, CASE WHEN target / close - 1 > 0.05 THEN 'undervalued' WHEN target / close - 1 < -0.05 THEN 'overvalued' ELSE 'neutral' END AS signal FROM (
        SELECT security_id, close, list_sort([own, ps, pm])[2] AS target FROM l JOIN (SELECT sector, round(quantile_cont(close, 0.5), 6) AS ps FROM l GROUP BY 1) USING (sector), (SELECT round(quantile_cont(close, 0.5), 6) AS pm FROM l))""",
        l="SELECT security_id, sector, max_by(close, trade_date) AS close, round(quantile_cont(close, 0.5), 6) AS own FROM price_daily JOIN security_master USING (security_id) GROUP BY 1, 2"),
    "sector_leaders": sql(PM, f"""SELECT sector, count(*) AS n, round(avg(r), 5) AS mean_return, round(avg(k), 5) AS strong_share FROM (SELECT security_id, max_by(r21, trade_date) AS r, max_by(near, trade_date) AS k FROM (
        SELECT *, close / {_lag(21)} - 1 AS r21, CASE WHEN close >= 0.9 * max(high) OVER (PARTITION BY security_id ORDER BY trade_date ROWS 251 PRECEDING) THEN 1.0 ELSE 0.0 END AS near FROM price_daily) GROUP BY 1) JOIN security_master USING (security_id) GROUP BY 1"""),
}
