"""Consensus, revisions, provider choice, splits, surprises."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.semantics import divide
from ..operators import consensus as c
from ..operators.asof import asof_join
from ..operators.periods import annual, wide_statements
from ..sources.views import price_daily, reports, sql, statements


def _daily(spark, d):
    return c.daily_consensus(reports(spark, d))


def daily_consensus(spark, d):
    return _daily(spark, d).select("security_id", "as_of", "n", F.round("mean", 7).alias("mean"), F.round("median", 7).alias("median"), "low", "high")


def target_consensus_boundaries(spark, d):
    return c.boundary_consensus(reports(spark, d)).select("security_id", "as_of", "n", F.round("mean", 7).alias("mean"))


def eps_revisions(spark, d):
    return c.revisions(_daily(spark, d).select("security_id", "as_of", "mean"), [30, 90]).select("security_id", "as_of", F.round("revision_30d", 4).alias("revision_30d"), F.round("revision_90d", 4).alias("revision_90d"))


def composite_provider(spark, d):
    dates = price_daily(spark, d).select("security_id", F.col("trade_date").alias("as_of"))
    return c.composite(reports(spark, d), ["B2", "B0", "B5"], dates).select("security_id", "as_of", "source_date", "estimate", "broker")


def composite_cut_off(spark, d):
    """The composite where one provider is historical: it ends when a current one starts on the security in 1997."""
    dates = price_daily(spark, d).select("security_id", F.col("trade_date").alias("as_of"))
    r = reports(spark, d).where("broker <> 'B5' OR report_date >= DATE'1997-01-01'")
    return c.composite(r, ["B2", "B5"], dates, historical=["B2"]).select("security_id", "as_of", "source_date", "estimate", "broker")


def split_adjust(spark, d):
    """A split of 2 on the first trading day of every odd year."""
    p = price_daily(spark, d).select("security_id", "trade_date", "close")
    splits = p.groupBy("security_id", F.year("trade_date").alias("y")).agg(F.min("trade_date").alias("split_date")).where("y % 2 = 1").select("security_id", "split_date", F.lit(2.0).alias("factor"))
    return c.split_adjusted(p, splits).select("security_id", "trade_date", F.round("adj_close", 8).alias("adj_close"))


def horizon_map(spark, d):
    p = statements(spark, d).select("security_id", F.last_day(F.make_date("fiscal_year", F.lit(12), F.lit(1))).alias("period_end")).distinct()
    return c.horizons(p, F.to_date(F.lit("1998-06-30")))


def surprise_events(spark, d):
    """Net income of a year against the latest estimate before it was reported, at most 180 days old."""
    actual = annual(wide_statements(statements(spark, d), ["NI"])).select("security_id", "fiscal_year", "report_date", (F.col("NI") / 1000).alias("actual"))
    est = c.validity(reports(spark, d), ["security_id"], 180).select("security_id", F.col("report_date").alias("estimate_date"), "estimate")
    out = asof_join(actual, est, ["security_id"], "report_date", "estimate_date", strict=True, max_age=180)
    return out.select("security_id", "fiscal_year", "estimate_date", F.round(divide((F.col("actual") - F.col("estimate")) * 100, F.abs("estimate")), 4).alias("surprise"))


def model_consensus(spark, d):
    """Mean, median, quartiles and dispersion (population deviation over the mean's size) of a year's estimates."""
    r = reports(spark, d).groupBy("security_id", F.year("report_date").alias("year"))
    return r.agg(F.count("*").alias("n"), F.round(F.avg("estimate"), 7).alias("mean"), *(F.round(F.percentile("estimate", q), 6).alias(f"p{int(q * 100)}") for q in (0.25, 0.5, 0.75)), F.round(divide(F.stddev_pop("estimate"), F.abs(F.avg("estimate"))), 6).alias("dispersion"))


def latest_reports(spark, d):
    """The latest report of each analyst on a security, and the mean of these."""
    r = reports(spark, d)
    last = r.withColumn("_r", F.row_number().over(Window.partitionBy("security_id", "analyst").orderBy(F.desc("report_date"), F.desc("report_idx")))).where("_r = 1")
    return last.groupBy("security_id").agg(F.count("*").alias("n_analysts"), F.round(F.avg("estimate"), 7).alias("mean"), F.max("report_date").alias("last_date"))


def estimate_revision_breadth(spark, d):
    """Of a month's reports, those above less those below the same broker's report before, over both."""
    w = Window.partitionBy("security_id", "broker").orderBy("report_date", "report_idx")
    r = reports(spark, d).withColumn("before", F.lag("estimate").over(w))
    g = r.groupBy("security_id", F.trunc("report_date", "month").alias("month")).agg(F.count_if(F.col("estimate") > F.col("before")).alias("up"), F.count_if(F.col("estimate") < F.col("before")).alias("down"))
    return g.withColumn("breadth", F.round((F.col("up") - F.col("down")) / F.greatest(F.col("up") + F.col("down"), F.lit(1)), 6))


QUERIES = {f.__name__: f for f in (daily_consensus, target_consensus_boundaries, eps_revisions, composite_provider, composite_cut_off, split_adjust, horizon_map, surprise_events, model_consensus, latest_reports, estimate_revision_breadth)}


def _spans(by, days):
    k = ", ".join(by)
    return f"SELECT *, least(coalesce(lead(report_date) OVER (PARTITION BY {k} ORDER BY report_date, report_idx), report_date + {days}), report_date + {days}) AS valid_to FROM (SELECT * FROM reports QUALIFY row_number() OVER (PARTITION BY {k}, report_date ORDER BY report_idx DESC) = 1)"


_CONS = {"sp": _spans(["security_id", "broker"], 181), "dc": "SELECT d.security_id, d.as_of, count(*) AS n, avg(estimate) AS mean, quantile_cont(estimate, 0.5) AS median, min(estimate) AS low, max(estimate) AS high FROM (SELECT DISTINCT security_id, report_date AS as_of FROM reports) d JOIN sp ON sp.security_id = d.security_id AND as_of >= report_date AND as_of < valid_to GROUP BY 1, 2"}
_prior = lambda k: f"SELECT a.security_id, a.as_of, a.mean AS now, b.mean AS then FROM dc a ASOF LEFT JOIN dc b ON a.security_id = b.security_id AND a.as_of - {k} >= b.as_of"
SQL = {
    "daily_consensus": sql("reports", "SELECT security_id, as_of, n, round(mean, 7) AS mean, round(median, 7) AS median, low, high FROM dc", **_CONS),
    "target_consensus_boundaries": sql("reports", "SELECT d.security_id, d.as_of, count(sp.security_id) AS n, round(avg(estimate), 7) AS mean FROM dd d LEFT JOIN sp ON sp.security_id = d.security_id AND d.as_of >= report_date AND d.as_of < valid_to GROUP BY 1, 2", sp=_spans(["security_id", "analyst"], 120), dd="SELECT security_id, report_date AS as_of FROM sp UNION SELECT security_id, valid_to FROM sp"),
    "eps_revisions": sql("reports", "SELECT x.security_id, x.as_of, round((x.now - x.then_) * 100 / greatest(abs(x.then_), 0.1), 4) AS revision_30d, round((y.now - y.then_) * 100 / greatest(abs(y.then_), 0.1), 4) AS revision_90d FROM x JOIN y USING (security_id, as_of)", **_CONS, x=_prior(30).replace("AS then", "AS then_"), y=_prior(90).replace("AS then", "AS then_")),
    "composite_provider": sql("reports price_daily", "SELECT p.security_id, p.trade_date AS as_of, n.report_date AS source_date, n.estimate, n.broker FROM price_daily p ASOF LEFT JOIN nw n ON p.security_id = n.security_id AND p.trade_date >= n.report_date", nw="SELECT * FROM reports WHERE broker IN ('B2', 'B0', 'B5') QUALIFY row_number() OVER (PARTITION BY security_id, report_date ORDER BY CASE broker WHEN 'B2' THEN 0 WHEN 'B0' THEN 1 ELSE 2 END, report_idx DESC) = 1"),
    "composite_cut_off": sql("reports price_daily", "SELECT p.security_id, p.trade_date AS as_of, n.report_date AS source_date, n.estimate, n.broker FROM price_daily p ASOF LEFT JOIN nw n ON p.security_id = n.security_id AND p.trade_date >= n.report_date",
        st="SELECT security_id, min(report_date) AS f FROM reports WHERE broker = 'B5' AND report_date >= DATE '1997-01-01' GROUP BY 1",
        nw="SELECT r.* FROM reports r LEFT JOIN st USING (security_id) WHERE (broker = 'B5' AND report_date >= DATE '1997-01-01') OR (broker = 'B2' AND (f IS NULL OR report_date < f)) QUALIFY row_number() OVER (PARTITION BY security_id, report_date ORDER BY broker, report_idx DESC) = 1"),
    "split_adjust": sql("price_daily", "SELECT p.security_id, trade_date, round(close / power(2, (SELECT count(*) FROM s WHERE s.security_id = p.security_id AND s.d > p.trade_date)), 8) AS adj_close FROM price_daily p", s="SELECT security_id, min(trade_date) AS d FROM price_daily GROUP BY security_id, year(trade_date) HAVING year(min(trade_date)) % 2 = 1"),
    "horizon_map": sql("statements", "SELECT security_id, e AS period_end, 'FY' || CASE WHEN f THEN row_number() OVER (PARTITION BY security_id, f ORDER BY e) ELSE 1 - row_number() OVER (PARTITION BY security_id, f ORDER BY e DESC) END AS horizon FROM (SELECT DISTINCT security_id, make_date(fiscal_year, 12, 31) AS e, make_date(fiscal_year, 12, 31) >= DATE '1998-06-30' AS f FROM statements)"),
    "surprise_events": sql("statements reports", "SELECT a.security_id, fiscal_year, CASE WHEN a.report_date - e.report_date <= 180 THEN e.report_date END AS estimate_date, round(CASE WHEN a.report_date - e.report_date <= 180 THEN (actual - estimate) * 100 / nullif(abs(estimate), 0) END, 4) AS surprise FROM a ASOF LEFT JOIN e ON a.security_id = e.security_id AND a.report_date > e.report_date",
        a="SELECT security_id, fiscal_year, report_date, amount / 1000 AS actual FROM statements WHERE fiscal_month = 12 AND canonical_id = 'NI'", e="SELECT * FROM reports QUALIFY row_number() OVER (PARTITION BY security_id, report_date ORDER BY report_idx DESC) = 1"),
    "model_consensus": sql("reports", "SELECT security_id, CAST(year(report_date) AS INTEGER) AS year, count(*) AS n, round(avg(estimate), 7) AS mean, round(quantile_cont(estimate, 0.25), 6) AS p25, round(quantile_cont(estimate, 0.5), 6) AS p50, round(quantile_cont(estimate, 0.75), 6) AS p75, round(stddev_pop(estimate) / nullif(abs(avg(estimate)), 0), 6) AS dispersion FROM reports GROUP BY 1, 2"),
    "latest_reports": sql("reports", "SELECT security_id, count(*) AS n_analysts, round(avg(estimate), 7) AS mean, max(report_date) AS last_date FROM (SELECT * FROM reports QUALIFY row_number() OVER (PARTITION BY security_id, analyst ORDER BY report_date DESC, report_idx DESC) = 1) GROUP BY 1"),
    "estimate_revision_breadth": sql("reports", "SELECT *, round((up - down) / greatest(up + down, 1), 6) AS breadth FROM (SELECT security_id, CAST(date_trunc('month', report_date) AS DATE) AS month, count(*) FILTER (WHERE estimate > b) AS up, count(*) FILTER (WHERE estimate < b) AS down FROM (SELECT *, lag(estimate) OVER (PARTITION BY security_id, broker ORDER BY report_date, report_idx) AS b FROM reports) GROUP BY 1, 2)"),
}
