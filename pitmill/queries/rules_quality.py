"""Mapping rules, data quality, operating metrics, streams."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.semantics import divide
from ..operators import rules as r
from ..operators.periods import wide_statements
from ..sources import readers
from ..sources.tables import shared_path
from ..sources.views import ITEMS, read, reports, security_master, sql, statements
from ..streaming import event_time as et
from ..streaming import incremental as inc
from ..streaming.chain import SnapshotChain
from .scoring import FACTORS as _FACTORS

RULES = [{"canonical": "RED_ITEM", "all": ["RED"]}, {"canonical": "BOLT_SIZED", "all": ["BOLT"], "any": ["SMALL", "MEDIUM"]}, {"canonical": "PROMO", "any": ["PROMO"], "none": ["WIDGET"]}, {"canonical": "GEAR", "all": ["GEAR"], "none": ["LARGE"]}]
PATTERNS = [("COLOUR", "RED|BLUE|GREEN", 2.0, 0), ("PART", "BOLT|GEAR|RING", 1.8, 1), ("GADGET", "WIDGET|GIZMO", 1.8, 2), ("SIZE", "LARGE|SMALL|MEDIUM", 1.0, 3), ("OFFER", "PROMO|ECONOMY|STANDARD", 1.9, 4)]


def _parts(spark, d):
    return read(spark, d, "part").select("p_partkey", F.upper(F.concat_ws(" ", "p_name", "p_type")).alias("label"), "p_brand", "p_retailprice")


def account_mapping(spark, d):
    return r.map_accounts(_parts(spark, d), "label", r.rule_table(spark, RULES)).select("p_partkey", "label", "canonical")


def sector_classify(spark, d):
    out = r.classify(_parts(spark, d), "label", spark.createDataFrame(PATTERNS, "code string, pattern string, weight double, priority int"))
    return out.select("p_partkey", "code", F.round("confidence", 6).alias("confidence"))


def mapping_coverage(spark, d):
    """By canonical account: rows, distinct types, share of the amount."""
    m = r.map_accounts(_parts(spark, d), "label", r.rule_table(spark, RULES))
    total = m.agg(F.sum("p_retailprice").alias("t"))
    g = m.groupBy("canonical").agg(F.count("*").alias("n_rows"), F.count_distinct("label").alias("n_types"), F.sum("p_retailprice").alias("amount"))
    return g.crossJoin(F.broadcast(total)).select("canonical", "n_rows", "n_types", F.round(divide("amount", "t"), 6).alias("share"))


def inconsistent_mapping(spark, d):
    """Types whose parts carry many brands, as one name mapped in several ways."""
    return _parts(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("p_brand").alias("n_brands")).where("n_brands > 1")


def _lines(spark, d):
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_returnflag", "l_linestatus")


def subtotal_dedupe(spark, d):
    """Of an order's rows with one flag keep one: without discount only if all are, the most discounted first."""
    return r.drop_empty_subtotals(_lines(spark, d), ["l_orderkey", "l_returnflag"], "l_discount", [F.desc("l_discount"), "l_linenumber"]).select("l_orderkey", "l_returnflag", "l_linenumber", "l_discount")


def is_cis_priority(spark, d):
    """Rows of status F go where the order and supplier also have status O."""
    rows = _lines(spark, d).withColumn("statement_type", F.when(F.col("l_linestatus") == "O", "IS").otherwise("CIS")).withColumn("supplier_group", F.col("l_suppkey") % 5)
    return r.prefer_statement(rows, ["l_orderkey", "supplier_group"], "IS", "CIS").select("l_orderkey", "l_linenumber", "statement_type")


def structure_outline(spark, d):
    rows = _lines(spark, d).withColumn("indent", (F.col("l_linenumber") % 3).cast("int"))
    return r.outline(rows, ["l_orderkey"], "l_linenumber", "indent").select("l_orderkey", "l_linenumber", "indent", "has_children")


def context_classify(spark, d):
    """Each row's path of parents; lines are put in order by number, part and supplier."""
    place = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    rows = _lines(spark, d).withColumn("place", place).select("l_orderkey", "place", ((F.col("place") - 1) % 3).cast("int").alias("indent"), F.concat("l_returnflag", F.col("place").cast("string")).alias("name"))
    return r.context_paths(rows, ["l_orderkey"], "place", "indent", "name").select("l_orderkey", "place", "path")


CHECKS = {"assets_cover_equity": ("TA - SEQ", "LCT + DLTT + DLC"), "gross_profit": ("SALE - COGS", "SALE * 0.42"), "equity_share": ("SEQ", "0.45 * TA"), "cash": ("CHE", "0.1 * SEQ + 30 * (SEQ / 900)")}


def _wide(spark, d):
    return wide_statements(statements(spark, d), list(ITEMS))


def _checks(spark, d):
    return r.checks(_wide(spark, d), ["security_id", "fiscal_year", "fiscal_month"], CHECKS, 1.0, 0.15)


def formula_checks(spark, d):
    return _checks(spark, d).select("security_id", "fiscal_year", "fiscal_month", "check_id", F.round("difference", 4).alias("difference"), "status")


def failure_clusters(spark, d):
    return _checks(spark, d).where("status = 'FAIL'").groupBy("check_id", "fiscal_month").agg(F.count("*").alias("n"), F.count_distinct("security_id").alias("n_securities"))


def filing_verdicts(spark, d):
    """100 less 20 an error and 5 a missing core account, not below 0."""
    bad = _checks(spark, d).groupBy("security_id", "fiscal_year").agg(F.count_if(F.col("status") == "FAIL").alias("errors"), F.count_if(F.col("status") == "SKIP").alias("skips"))
    score = F.greatest(F.lit(0), 100 - 20 * F.col("errors") - 5 * F.col("skips"))
    return bad.select("security_id", "fiscal_year", "errors", score.alias("score"), F.when(F.col("errors") > 3, "FAIL").when(F.col("errors") > 0, "WARN").otherwise("PASS").alias("verdict"))


def missing_core(spark, d):
    """Required accounts that a security's quarter lacks, between its first and last year."""
    s = statements(spark, d).where("amount <> 0")
    periods = s.select("security_id", "fiscal_year").distinct().crossJoin(F.broadcast(spark.createDataFrame([(3,), (6,), (9,), (12,)], "fiscal_month int")))
    need = periods.crossJoin(F.broadcast(spark.createDataFrame([("SALE",), ("NI",), ("TA",), ("SEQ",)], "canonical_id string")))
    return need.join(s.select("security_id", "fiscal_year", "fiscal_month", "canonical_id").distinct(), ["security_id", "fiscal_year", "fiscal_month", "canonical_id"], "left_anti")


def duplicate_risks(spark, d):
    return _lines(spark, d).groupBy("l_orderkey", "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("n_suppliers")).where("n > 1")


def jump_anomalies(spark, d, times: float = 5.0):
    """Every account's change over a year, and whether its size grew or fell by ``times``."""
    w = Window.partitionBy("security_id", "canonical_id", "fiscal_month").orderBy("fiscal_year")
    s = statements(spark, d).withColumn("before", F.lag("amount").over(w)).withColumn("ratio", divide(F.abs("amount"), F.abs("before")))
    return s.where("ratio IS NOT NULL").select("security_id", "canonical_id", "fiscal_year", "fiscal_month", F.round("ratio", 6).alias("ratio"), ((F.col("ratio") >= times) | (F.col("ratio") * times <= 1)).alias("is_jump"))


def readiness_matrix(spark, d):
    """Which factor families a security's year has all accounts for."""
    have = statements(spark, d).where("amount <> 0").groupBy("security_id", "fiscal_year").agg(F.collect_set("canonical_id").alias("a"))
    need = {"profitability": ["SALE", "COGS", "NI"], "leverage": ["DLTT", "DLC", "SEQ"], "dividends": ["DIV"]}
    return have.select("security_id", "fiscal_year", *(F.forall(F.array(*map(F.lit, ids)), lambda x: F.array_contains("a", x)).alias(k) for k, ids in need.items()))


def operating_metrics(spark, d):
    """Metrics from JSON cells by keyword, with unit scaling."""
    cells = read(spark, d, "events").select("event_id", "user_id", "event_type", "value", F.from_json("props", "map<string,double>").alias("m"))
    rows = cells.select("event_id", "user_id", "event_type", "value", F.explode("m").alias("header", "amount"))
    metric = F.when(F.col("event_type").rlike("purchase|signup"), "quantity").when(F.col("event_type").rlike("view|click"), "traffic").otherwise("other")
    return rows.groupBy("user_id", metric.alias("metric_id"), "header").agg(F.count("*").alias("n"), F.round(F.sum(F.col("amount") * 1000), 4).alias("amount"))


def _economics(spark, d):
    x = _lines(spark, d).join(read(spark, d, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(read(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("year")), F.col("l_orderkey") == F.col("o_orderkey"))
    return x.groupBy("p_brand", "year").agg(F.sum("l_quantity").alias("q"), F.sum("l_extendedprice").alias("revenue"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 0.8).alias("cost"))


def unit_economics(spark, d):
    w = Window.partitionBy("year")
    e = _economics(spark, d)
    return e.select("p_brand", "year", F.round(divide("revenue", "q"), 6).alias("asp"), F.round(divide("cost", "q"), 6).alias("unit_cost"), F.round(divide(F.col("revenue") - F.col("cost"), "revenue"), 6).alias("margin"), F.round(divide("revenue", F.sum("revenue").over(w)), 6).alias("share"))


def _drivers(spark, d):
    e = _economics(spark, d).select("p_brand", "year", "q", divide("revenue", "q").alias("asp"), divide("cost", "q").alias("unit_cost"), "revenue")
    before = e.select("p_brand", (F.col("year") + 1).alias("year"), *(F.col(c).alias(f"{c}_b") for c in ("q", "asp", "unit_cost", "revenue")))
    return e.join(before, ["p_brand", "year"]).select("p_brand", "year", "q", "asp", "unit_cost", *((divide(c, f"{c}_b") - 1).alias(f"{c}_yoy") for c in ("q", "asp", "unit_cost", "revenue")))


def operating_drivers(spark, d):
    return _drivers(spark, d).select("p_brand", "year", *(F.round(f"{c}_yoy", 6).alias(f"{c}_yoy") for c in ("q", "asp", "unit_cost", "revenue")))


def pqc_forecast(spark, d):
    """Next year's quantity, price and cost by blended growth: half quantity and half revenue; price and cost by 0.7 / 0.3 and 0.6 / 0.4."""
    x = _drivers(spark, d)
    q = 0.5 * F.col("q_yoy") + 0.5 * F.col("revenue_yoy")
    asp = 0.7 * F.col("asp_yoy") + 0.3 * F.col("revenue_yoy")
    cost = 0.6 * F.col("unit_cost_yoy") + 0.4 * asp
    return x.select("p_brand", (F.col("year") + 1).alias("year"), F.round(F.col("q") * (1 + q), 4).alias("quantity"), F.round(F.col("asp") * (1 + asp), 4).alias("asp"), F.round(F.col("unit_cost") * (1 + cost), 4).alias("unit_cost"))


def _melted(spark, d):
    """Factor ids of the long factor rows: three price factors by security's region, and the statement items as growth and margins."""
    from .scoring import factors

    prices = factors(spark, d).join(security_master(spark, d).select("security_id", "sector"), "security_id").select(F.concat_ws("_", "factor_id", F.lower(F.regexp_replace("sector", " ", "_"))).alias("factor_id"))
    items = statements(spark, d).select(F.concat(F.lower("canonical_id"), F.when(F.col("statement_type") == "BS", "_yoy").when(F.col("statement_type") == "IS", "_margin").otherwise("_days")).alias("factor_id"))
    return prices.unionByName(items)


def factor_catalog(spark, d):
    """Type, unit and direction of every factor id that the long rows hold, and its number of rows."""
    n = _melted(spark, d).groupBy("factor_id").agg(F.count("*").alias("n_rows"))
    return readers.catalog(n).join(n, "factor_id")


def consensus_row_keys(spark, d):
    """Repeated loads of the same rows leave one row a key."""
    o = read(spark, d, "orders").select((F.col("o_custkey") % 50).cast("string").alias("broker"), F.to_date("o_orderdate").cast("string").alias("day"))
    return readers.with_row_key(o.unionByName(o), ["broker", "day"]).select("row_key", "broker", "day")


def stream_latest_version(spark, d):
    """The newest event of each user and type, merged over several batches of a stream."""
    e = inc.read_stream(spark, _event_files(spark, d)).select("user_id", "event_type", "event_id", "ts", "value")
    return inc.keep_latest(e, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id", "value")


def _event_files(spark, d):
    """The events as a folder of several files, so that a stream takes them in several batches, days across batches."""
    path = shared_path(spark, "events")
    e = read(spark, d, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value")
    e.repartition(5, "event_id").write.parquet(path)
    return path


def stream_snapshot(spark, d):
    """Counts and sums of events by type and day, added up over the batches of a stream."""
    e = inc.read_stream(spark, _event_files(spark, d))
    e = e.withColumn("day", F.to_date("ts"))
    out = inc.keep_sums(e, ["event_type", "day"], {"n": F.lit(1).cast("long"), "total": F.col("value").cast("decimal(24,6)")})
    return out.select("event_type", "day", "n", F.round(F.col("total").cast("double"), 4).alias("total"))


def stream_daily_counts(spark, d):
    """Event-time windows, emitted when the watermark closes them and then forgotten; a last row far ahead closes all."""
    path = shared_path(spark, "windows")
    source = _event_files(spark, d)
    end = spark.read.parquet(source).agg((F.max("ts") + F.expr("INTERVAL 90 DAY")).alias("ts"))
    end.select(F.lit(None).cast("long").alias("event_id"), "ts", F.lit(None).cast("long").alias("user_id"), F.lit(None).cast("string").alias("event_type"), F.lit(None).cast("double").alias("value")).coalesce(1).write.mode("append").parquet(source)
    counts, _ = et.closed_windows(inc.read_stream(spark, source), "ts", ["event_type"], path, "1 day", "40 days")
    return counts.select("event_type", F.to_date("start").alias("day"), "n")


def stream_live_estimates(spark, d):
    """Reports as a stream: each broker's latest estimate, if not expired on the newest day."""
    path = shared_path(spark, "reports")
    reports(spark, d).repartition(4, "report_idx").write.parquet(path)
    return inc.live_estimates(inc.read_stream(spark, path), ["security_id", "broker"], "report_date", "report_idx").select("security_id", "broker", "report_date", "estimate", "as_of")


def stream_late_filings(spark, d):
    """Year-end snapshots of net income as known then, written once, though filings and corrections arrive in several batches."""
    path = shared_path(spark, "filings")
    statements(spark, d).where("canonical_id = 'NI'").select("security_id", "fiscal_year", "fiscal_month", "amount", "report_date").write.parquet(f"{path}/all")
    s = spark.read.parquet(f"{path}/all")
    fixed = s.where("fiscal_month = 6").withColumn("amount", F.col("amount") * 2).withColumn("report_date", F.date_add("report_date", 200))
    both = s.unionByName(fixed)
    cuts = ["1900-01-01", "1998-01-01", "2000-01-01", "2100-01-01"]
    chain = SnapshotChain(spark, f"{path}/chain", [date(y, 12, 31) for y in range(1995, 2002)], ["security_id", "fiscal_year", "fiscal_month"], "report_date")
    between = lambda low, high: both.where((F.col("report_date") >= low) & (F.col("report_date") < high))
    files = inc.write_in_turn([between(low, high) for low, high in zip(cuts, cuts[1:])], f"{path}/in")  # in the order in which they became known
    inc.drain(inc.read_stream(spark, f"{path}/in/part=*", files), chain.append, f"{path}/checkpoint")
    return chain.snapshots().groupBy("snapshot_date", "security_id").agg(F.count("*").alias("n"), F.round(F.sum("amount"), 2).alias("total"))


QUERIES = {f.__name__: f for f in (account_mapping, sector_classify, mapping_coverage, inconsistent_mapping, subtotal_dedupe, is_cis_priority, structure_outline, context_classify, formula_checks, failure_clusters, filing_verdicts, missing_core, duplicate_risks, jump_anomalies, readiness_matrix, operating_metrics, unit_economics, operating_drivers, pqc_forecast, factor_catalog, consensus_row_keys, stream_latest_version, stream_snapshot, stream_daily_counts, stream_live_estimates, stream_late_filings)}

_MAP = "CASE WHEN contains(t, 'RED') THEN 'RED_ITEM' WHEN contains(t, 'BOLT') AND (contains(t, 'SMALL') OR contains(t, 'MEDIUM')) THEN 'BOLT_SIZED' WHEN contains(t, 'PROMO') AND NOT contains(t, 'WIDGET') THEN 'PROMO' WHEN contains(t, 'GEAR') AND NOT contains(t, 'LARGE') THEN 'GEAR' ELSE 'UNMAPPED' END"
_LABEL = "SELECT *, upper(p_name || ' ' || p_type) AS t FROM part"
_M = f"SELECT p_partkey, t AS label, p_retailprice, {_MAP} AS canonical FROM ({_LABEL})"
_HIT = " UNION ALL ".join(f"SELECT t, '{c}' AS code, {w}::DOUBLE AS w, {p} AS p FROM ts WHERE regexp_matches(t, '{x}')" for c, x, w, p in PATTERNS)
_WIDE = {"wide": "SELECT security_id, fiscal_year, fiscal_month, " + ", ".join(f"max(CASE WHEN canonical_id = '{c}' THEN amount END) AS {c}" for c in ITEMS) + " FROM statements GROUP BY 1, 2, 3"}
_CK = _WIDE | {"ck": "SELECT *, CASE WHEN difference IS NULL THEN 'SKIP' WHEN abs(difference) <= greatest(1.0, abs(rs) * 0.15) THEN 'PASS' ELSE 'FAIL' END AS status FROM (SELECT *, ls - rs AS difference FROM (" + " UNION ALL ".join(f"SELECT security_id, fiscal_year, fiscal_month, '{n}' AS check_id, {a} AS ls, {b} AS rs FROM wide" for n, (a, b) in CHECKS.items()) + "))"}
_ECO = {"eco": "SELECT p_brand, CAST(year(o_orderdate) AS INTEGER) AS year, sum(l_quantity) AS q, sum(l_extendedprice) AS revenue, sum(l_extendedprice * (1 - l_discount) * 0.8) AS cost FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2",
        "drv": "SELECT a.p_brand, a.year, a.q, a.revenue / a.q AS asp, a.cost / a.q AS unit_cost, a.q / b.q - 1 AS q_yoy, (a.revenue / a.q) / (b.revenue / b.q) - 1 AS asp_yoy, (a.cost / a.q) / (b.cost / b.q) - 1 AS unit_cost_yoy, a.revenue / b.revenue - 1 AS revenue_yoy FROM eco a JOIN eco b ON a.p_brand = b.p_brand AND a.year = b.year + 1"}
SQL = {
    "account_mapping": f"SELECT p_partkey, label, canonical FROM ({_M})",
    "sector_classify": f"WITH ts AS (SELECT DISTINCT t FROM ({_LABEL})), h AS ({_HIT}), g AS (SELECT t, code, sum(w) AS w, min(p) AS p FROM h GROUP BY 1, 2) SELECT p_partkey, code, round(w / total, 6) AS confidence FROM ({_LABEL}) p LEFT JOIN (SELECT t, code, w, sum(w) OVER (PARTITION BY t) AS total FROM g QUALIFY row_number() OVER (PARTITION BY t ORDER BY w DESC, p, code DESC) = 1) x ON p.t = x.t",
    "mapping_coverage": f"SELECT canonical, count(*) AS n_rows, count(DISTINCT label) AS n_types, round(sum(p_retailprice) / (SELECT sum(p_retailprice) FROM part), 6) AS share FROM ({_M}) GROUP BY 1",
    "inconsistent_mapping": f"SELECT t AS label, count(*) AS n, count(DISTINCT p_brand) AS n_brands FROM ({_LABEL}) GROUP BY 1 HAVING count(DISTINCT p_brand) > 1",
    "subtotal_dedupe": "SELECT l_orderkey, l_returnflag, l_linenumber, l_discount FROM (SELECT *, max(abs(l_discount)) OVER (PARTITION BY l_orderkey, l_returnflag) AS m FROM lineitem) WHERE m = 0 OR abs(l_discount) > 0 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_discount DESC, l_linenumber) = 1",
    "is_cis_priority": "SELECT l_orderkey, l_linenumber, k AS statement_type FROM (SELECT *, CASE WHEN l_linestatus = 'O' THEN 'IS' ELSE 'CIS' END AS k, bool_or(l_linestatus = 'O') OVER (PARTITION BY l_orderkey, l_suppkey % 5) AS h FROM lineitem) WHERE NOT (k = 'CIS' AND h)",
    "structure_outline": "SELECT l_orderkey, l_linenumber, i AS indent, coalesce(lead(i) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) > i, false) AS has_children FROM (SELECT *, CAST(l_linenumber % 3 AS INTEGER) AS i FROM lineitem)",
    "context_classify": """SELECT l_orderkey, place, concat_ws(' > ', CASE WHEN i >= 1 THEN last_value(CASE WHEN i = 0 THEN n END IGNORE NULLS) OVER w END, CASE WHEN i >= 2 THEN last_value(CASE WHEN i = 1 THEN n END IGNORE NULLS) OVER w END) AS path
        FROM (SELECT l_orderkey, place, (place - 1) % 3 AS i, l_returnflag || place AS n FROM (SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS INTEGER) AS place FROM lineitem)) WINDOW w AS (PARTITION BY l_orderkey ORDER BY place)""",
    "formula_checks": sql("statements", "SELECT security_id, fiscal_year, fiscal_month, check_id, round(difference, 4) AS difference, status FROM ck", **_CK),
    "failure_clusters": sql("statements", "SELECT check_id, fiscal_month, count(*) AS n, count(DISTINCT security_id) AS n_securities FROM ck WHERE status = 'FAIL' GROUP BY 1, 2", **_CK),
    "filing_verdicts": sql("statements", "SELECT security_id, fiscal_year, errors, greatest(0, 100 - 20 * errors - 5 * skips) AS score, CASE WHEN errors > 3 THEN 'FAIL' WHEN errors > 0 THEN 'WARN' ELSE 'PASS' END AS verdict FROM (SELECT security_id, fiscal_year, count(*) FILTER (WHERE status = 'FAIL') AS errors, count(*) FILTER (WHERE status = 'SKIP') AS skips FROM ck GROUP BY 1, 2)", **_CK),
    "missing_core": sql("statements", "SELECT p.security_id, p.fiscal_year, m AS fiscal_month, c AS canonical_id FROM (SELECT DISTINCT security_id, fiscal_year FROM statements WHERE amount <> 0) p, (VALUES (3), (6), (9), (12)) t(m), (VALUES ('SALE'), ('NI'), ('TA'), ('SEQ')) u(c) WHERE NOT EXISTS (SELECT 1 FROM statements s WHERE s.security_id = p.security_id AND s.fiscal_year = p.fiscal_year AND s.fiscal_month = m AND s.canonical_id = c AND s.amount <> 0)"),
    "duplicate_risks": "SELECT l_orderkey, l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_suppkey) AS n_suppliers FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) > 1",
    "jump_anomalies": sql("statements", "SELECT security_id, canonical_id, fiscal_year, fiscal_month, round(q, 6) AS ratio, q >= 5 OR q * 5 <= 1 AS is_jump FROM (SELECT *, abs(amount) / nullif(abs(lag(amount) OVER (PARTITION BY security_id, canonical_id, fiscal_month ORDER BY fiscal_year)), 0) AS q FROM statements) WHERE q IS NOT NULL"),
    "readiness_matrix": sql("statements", "SELECT security_id, fiscal_year, count(DISTINCT canonical_id) FILTER (WHERE canonical_id IN ('SALE', 'COGS', 'NI')) = 3 AS profitability, count(DISTINCT canonical_id) FILTER (WHERE canonical_id IN ('DLTT', 'DLC', 'SEQ')) = 3 AS leverage, count(DISTINCT canonical_id) FILTER (WHERE canonical_id = 'DIV') = 1 AS dividends FROM statements WHERE amount <> 0 GROUP BY 1, 2"),
    "operating_metrics": "SELECT user_id, CASE WHEN regexp_matches(event_type, 'purchase|signup') THEN 'quantity' WHEN regexp_matches(event_type, 'view|click') THEN 'traffic' ELSE 'other' END AS metric_id, k AS header, count(*) AS n, round(sum(CAST(json_extract(props, '$.' || k) AS DOUBLE) * 1000), 4) AS amount FROM (SELECT *, unnest(json_keys(props)) AS k FROM events) GROUP BY 1, 2, 3",
    "unit_economics": f"WITH eco AS ({_ECO['eco']}) SELECT p_brand, year, round(revenue / q, 6) AS asp, round(cost / q, 6) AS unit_cost, round((revenue - cost) / revenue, 6) AS margin, round(revenue / sum(revenue) OVER (PARTITION BY year), 6) AS share FROM eco",
    "operating_drivers": f"WITH eco AS ({_ECO['eco']}), drv AS ({_ECO['drv']}) SELECT p_brand, year, round(q_yoy, 6) AS q_yoy, round(asp_yoy, 6) AS asp_yoy, round(unit_cost_yoy, 6) AS unit_cost_yoy, round(revenue_yoy, 6) AS revenue_yoy FROM drv",
    "pqc_forecast": f"WITH eco AS ({_ECO['eco']}), drv AS ({_ECO['drv']}) SELECT p_brand, year + 1 AS year, round(q * (1 + 0.5 * q_yoy + 0.5 * revenue_yoy), 4) AS quantity, round(asp * (1 + 0.7 * asp_yoy + 0.3 * revenue_yoy), 4) AS asp, round(unit_cost * (1 + 0.6 * unit_cost_yoy + 0.4 * (0.7 * asp_yoy + 0.3 * revenue_yoy)), 4) AS unit_cost FROM drv",
    "factor_catalog": sql("price_daily security_master statements", """SELECT f AS factor_id, CASE WHEN regexp_matches(f, '^(tr_|ret_|mom|high_|vol_|rsi|macd|na_|ma_)') THEN 'price' WHEN regexp_matches(f, '(per|pbr|psr|pcr|ev_|yield)') THEN 'valuation' WHEN regexp_matches(f, '(growth|yoy|cagr)') THEN 'growth' ELSE 'fundamental' END AS factor_type,
        CASE WHEN regexp_matches(f, '(pct|yoy|cagr|growth|yield|margin)') THEN 'percent' WHEN regexp_matches(f, 'days') THEN 'days' ELSE 'ratio' END AS unit, CASE WHEN regexp_matches(f, '^(per|pbr|psr|pcr|vol_|ev_to|debt|na_ratio)') THEN 'lower' ELSE 'higher' END AS value_direction, count(*) AS n_rows
        FROM (SELECT factor_id || '_' || lower(replace(sector, ' ', '_')) AS f FROM factors JOIN security_master USING (security_id)
        UNION ALL SELECT lower(canonical_id) || CASE statement_type WHEN 'BS' THEN '_yoy' WHEN 'IS' THEN '_margin' ELSE '_days' END FROM statements) GROUP BY f""", **{k: _FACTORS[k] for k in ("wide_f", "factors")}),
    "consensus_row_keys": "SELECT DISTINCT sha256(b || chr(31) || d) AS row_key, b AS broker, d AS day FROM (SELECT CAST(o_custkey % 50 AS VARCHAR) AS b, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS d FROM orders)",
    "stream_latest_version": "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "stream_snapshot": "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
    "stream_daily_counts": "SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_live_estimates": sql("reports", "SELECT security_id, broker, report_date, estimate, (SELECT max(report_date) FROM reports) AS as_of FROM reports WHERE true QUALIFY row_number() OVER (PARTITION BY security_id, broker ORDER BY report_date DESC, report_idx DESC) = 1 AND (SELECT max(report_date) FROM reports) - report_date <= 180"),
    "stream_late_filings": sql("statements", """SELECT snapshot_date, security_id, count(*) AS n, round(sum(amount), 2) AS total FROM (SELECT y AS snapshot_date, security_id, max_by(amount, report_date) AS amount FROM (SELECT make_date(CAST(i AS INTEGER), 12, 31) AS y FROM range(1995, 2002) t(i)) JOIN (
        SELECT security_id, fiscal_year, fiscal_month, amount, report_date FROM statements WHERE canonical_id = 'NI' UNION ALL SELECT security_id, fiscal_year, fiscal_month, amount * 2, report_date + 200 FROM statements WHERE canonical_id = 'NI' AND fiscal_month = 6) ON report_date <= y GROUP BY y, security_id, fiscal_year, fiscal_month) GROUP BY 1, 2"""),
}
