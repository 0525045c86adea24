"""Provider files, written from the tables and read back: benchmarks, statements, dividends, estimates, rates, facts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import rules as r
from ..sources import feeds as f
from ..sources.tables import shared_path
from ..sources.views import price_daily, read, security_master, sql, statements

ALIASES = [("idx africa", "AFR", "Africa All"), (" IDX AMERICA", "AMR", "America All"), ("IDX ASIA", "ASI", "Asia All"), ("IDX EUROPE", "EUR", "Europe All")]


def benchmark_normalized(spark, d):
    """Region indexes under their ids; one region has no alias and goes."""
    p = price_daily(spark, d).join(security_master(spark, d).select("security_id", "sector"), "security_id")
    raw = p.groupBy("sector", "trade_date").agg(F.avg("close").alias("c")).select(F.concat(F.lit("IDX "), "sector").alias("symbol"), F.col("trade_date").cast("string").alias("Date"), F.col("c").cast("string").alias("Close"))
    return f.normalize_benchmark(raw, spark.createDataFrame(ALIASES, "alias string, benchmark_id string, name string")).withColumn("close", F.round("close", 6))


def statements_compacted(spark, d):
    """Annual rows of a statement table that was compacted by year."""
    path = shared_path(spark, "statements")
    f.compact(statements(spark, d), path, "fiscal_year", ["security_id", "canonical_id"])
    return spark.read.parquet(path).where("fiscal_month = 12 AND statement_type = 'IS'").select("security_id", "fiscal_year", "canonical_id", "amount")


def dividend_scan(spark, d):
    """Dividends by stock and year from lines of JSON, and the number of lines that do not parse."""
    o = read(spark, d, "orders")
    line = F.to_json(F.struct((F.col("o_custkey") % 100).alias("stock_code"), F.year("o_orderdate").alias("bsns_year"), F.col("o_totalprice").alias("dps")))
    path = shared_path(spark, "dividends")
    o.select(F.when(F.col("o_orderkey") % 50 == 0, F.substring(line, 1, 20)).otherwise(line).alias("value")).write.text(path)
    good, bad = f.read_json_lines(spark, path, "stock_code long, bsns_year int, dps double")
    sums = good.groupBy("stock_code", "bsns_year").agg(F.count("*").alias("n"), F.round(F.sum("dps"), 2).alias("total"))
    failed = bad.agg(F.count("*").alias("n")).select(F.lit("failed").alias("kind"), "n")
    return sums.withColumn("kind", F.lit("ok")).unionByName(failed, allowMissingColumns=True).select("kind", "stock_code", "bsns_year", "n", "total")


def provider_observations(spark, d):
    """Nested estimate arrays to observations, summed by symbol, period and statistic."""
    lines = read(spark, d, "lineitem")
    period = F.element_at(F.array(*map(F.lit, ("0q", "+1q", "0y", "+1y"))), ((F.col("l_linenumber") - 1) % 4 + 1).cast("int"))
    one = F.struct(period.alias("period"), F.col("l_extendedprice").alias("avg"), F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("low"), F.col("l_tax").alias("high"))
    payloads = lines.groupBy("l_orderkey").agg(F.min("l_suppkey").cast("string").alias("symbol"), F.collect_list(one).alias("trend")).select(F.to_json(F.struct("symbol", "trend")).alias("payload"))
    return f.observations(payloads).groupBy("symbol", "period", "statistic").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


def _rates(spark, d):
    o = read(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("DATE"), (F.col("o_custkey") % 5).alias("k")).agg(F.avg("o_totalprice").alias("x"))
    return o.select("k", "DATE", F.when(F.dayofmonth("DATE") % 7 == 0, F.lit(".")).otherwise(F.floor(F.col("x") / 500).cast("string")).alias("DGS10"))


def risk_free_rates(spark, d):
    """Rates from CSV files, one a market; days without a value go."""
    out = None
    for k, market in enumerate(["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]):
        path = shared_path(spark, "rates")
        _rates(spark, d).where(F.col("k") == k).select("DATE", "DGS10").write.option("header", True).csv(path)
        one = f.normalize_rates(spark.read.option("header", True).schema("DATE string, DGS10 string").csv(path), "DGS10", market)
        out = one if out is None else out.unionByName(one)
    return out


def country_premiums(spark, d):
    """Equity risk premiums by country from percent texts."""
    n = read(spark, d, "nation")
    raw = n.select(F.concat(F.lit(" "), "n_name").alias("country"), F.when(F.col("n_nationkey") % 6 == 0, "n/a").otherwise(F.concat((F.col("n_nationkey") * 0.25 + 3).cast("string"), F.lit("%"))).alias("premium"), F.concat((F.col("n_regionkey") + 20).cast("string"), F.lit(" %")).alias("tax_rate"))
    return f.normalize_country_premiums(raw.withColumn("tax_rate", F.regexp_replace("tax_rate", " ", "")))


def provider_latest(spark, d):
    """Each ticker's rows of its newest monthly snapshot."""
    o = read(spark, d, "orders").select((F.col("o_custkey") % 300).alias("ticker"), F.last_day("o_orderdate").alias("snapshot_date"), "o_orderkey", "o_totalprice")
    return f.latest_provider_snapshot(o, "ticker", "snapshot_date")


def dividends_by_kind(spark, d):
    """By year and share kind: of a month's disclosures the latest counts, then months are summed."""
    lines = read(spark, d, "lineitem").where("l_discount >= 0.05").select("l_suppkey", F.year("l_shipdate").alias("bsns_year"), F.month("l_shipdate").alias("m"), F.col("l_returnflag").alias("stock_kind"), "l_shipdate", "l_orderkey", "l_linenumber", "l_quantity")
    latest = lines.groupBy("l_suppkey", "bsns_year", "m", "stock_kind").agg(F.max_by("l_quantity", F.struct("l_shipdate", "l_orderkey", "l_linenumber")).alias("dps"))
    return latest.groupBy("l_suppkey", "bsns_year", "stock_kind").agg(F.sum("dps").alias("dps"), F.count("*").alias("n_disclosures"))


def providers_combined(spark, d):
    """Reports of two providers, one with codes and one with company names only."""
    s = read(spark, d, "supplier")
    names = s.select(F.col("s_name").alias("name"), F.concat(F.lit("SEC_US_"), F.col("s_suppkey").cast("string")).alias("security_id"))
    lines = read(spark, d, "lineitem").where("l_linenumber = 1").select("l_orderkey", "l_suppkey", "l_extendedprice")
    coded = lines.where("l_orderkey % 2 = 0").select(F.lit("A").alias("provider"), F.concat(F.lit("SEC_US_"), F.col("l_suppkey").cast("string")).alias("security_id"), F.lit(None).cast("string").alias("company_name"), F.col("l_extendedprice").alias("estimate"))
    named = lines.where("l_orderkey % 2 = 1").join(s.select("s_suppkey", "s_name"), F.col("l_suppkey") == F.col("s_suppkey"))
    named = named.select(F.lit("B").alias("provider"), F.lower(F.regexp_replace("s_name", "#", " - ")).alias("company_name"), F.col("l_extendedprice").alias("estimate"))
    both = f.combine_reports([coded, named], names)
    return both.groupBy("provider", "security_id").agg(F.count("*").alias("n"), F.round(F.sum("estimate"), 2).alias("total"))


def amounts_by_pattern(spark, d):
    """The amount of the largest size among a brand's accounts whose name fits a pattern; for debts without its sign."""
    p = read(spark, d, "part").select("p_brand", "p_partkey", F.upper("p_name").alias("account_name"), F.element_at(F.array(*map(F.lit, ("BS", "IS", "CF"))), (F.col("p_size") % 3 + 1).cast("int")).alias("statement_type"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_retailprice")).otherwise(-F.col("p_retailprice")).alias("amount"))
    return r.amounts_by_pattern(p, ["p_brand"], {"retained": ("RED|BLUE", ["BS"], False), "debt": ("GEAR|BOLT", ["BS"], True), "interest": ("WIDGET", ["CF", "IS"], True)}, tie="p_partkey").select("p_brand", "retained", "debt", "interest")


FACT_RULES = [(1, "tag", "PROMO BRUSHED", "REVENUE"), (2, "tag", "SMALL", "COGS"), (3, "label", "RED", "INVENTORY"), (4, "label", "GEAR", "PPE"), (5, "note", "LARGE", "OTHER_ASSETS")]


def us_fact_accounts(spark, d):
    """Facts of annual and quarterly forms to accounts: rules on tag, label, then note; the first that fits."""
    p = read(spark, d, "part")
    form = F.element_at(F.array(*map(F.lit, ("10-K", "10-Q", "8-K", "10-K/A"))), (F.col("p_partkey") % 4 + 1).cast("int"))
    facts = p.select("p_partkey", F.upper("p_type").alias("tag"), F.upper("p_name").alias("label"), F.upper("p_brand").alias("note"), form.alias("form"), F.make_date(F.lit(2020), (F.col("p_partkey") % 12 + 1).cast("int"), F.lit(15)).alias("end_date"))
    return r.map_facts(facts, FACT_RULES, ["10-K", "10-Q", "10-K/A"]).select("p_partkey", "form", "canonical_id", "fiscal_month")


def classification_review(spark, d):
    """Classes with manual overrides, and whether one should look at them: low confidence and no override."""
    from .rules_quality import sector_classify

    over = read(spark, d, "part").where("p_size = 7").select("p_partkey", F.lit("MANUAL").alias("override"))
    return r.with_overrides(sector_classify(spark, d), over, "p_partkey", "code", "confidence", 0.9)


def metric_flags(spark, d):
    """Normal metric rows: names fall back from product to segment to company; flags tell inferred units and proxies."""
    e = read(spark, d, "events").select("event_id", "event_type", "user_id", "value")
    metric = F.create_map(*map(F.lit, ("view", "shipment_volume", "click", "capacity", "purchase", "revenue", "signup", "derived_users", "error", "utilization_rate")))[F.col("event_type")]
    raw = e.select("event_id", metric.alias("metric_id"), F.when(F.col("user_id") % 3 == 0, "inferred_ton").otherwise("ton").alias("unit"), F.when(F.col("user_id") % 4 == 0, "").otherwise(F.concat(F.lit("segment "), (F.col("user_id") % 7).cast("string"))).alias("segment"), F.when(F.col("user_id") % 5 == 0, F.lit("product")).alias("product"), "value")
    return r.normalize_metrics(raw).select("event_id", "metric_id", "metric_name", "value_type", "product_name", "flags")


QUERIES = {q.__name__: q for q in (benchmark_normalized, statements_compacted, dividend_scan, provider_observations, risk_free_rates, country_premiums, provider_latest, dividends_by_kind, providers_combined, amounts_by_pattern, us_fact_accounts, classification_review, metric_flags)}

RATES = "SELECT ['AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST'][CAST(o_custkey % 5 + 1 AS BIGINT)] AS market, CAST(o_orderdate AS DATE) AS rate_date, floor(avg(o_totalprice) / 500)::DOUBLE AS rate FROM orders WHERE day(o_orderdate) % 7 <> 0 GROUP BY 1, 2"
_PART = "SELECT *, upper(p_name) AS n, ['BS', 'IS', 'CF'][p_size % 3 + 1] AS st, CASE WHEN p_partkey % 2 = 0 THEN p_retailprice ELSE -p_retailprice END AS amount FROM part"
_pick = lambda rx, st, abs_: f"{'abs' if abs_ else ''}(arg_max(amount, (abs(amount), -p_partkey)) FILTER (WHERE regexp_matches(n, '{rx}') AND st IN ({st})))"
SQL = {
    "benchmark_normalized": sql("price_daily security_master", "SELECT CASE sector WHEN 'AFRICA' THEN 'AFR' WHEN 'AMERICA' THEN 'AMR' WHEN 'ASIA' THEN 'ASI' ELSE 'EUR' END AS benchmark_id, CASE sector WHEN 'AFRICA' THEN 'Africa All' WHEN 'AMERICA' THEN 'America All' WHEN 'ASIA' THEN 'Asia All' ELSE 'Europe All' END AS name, trade_date, round(avg(close), 6) AS close FROM price_daily JOIN security_master USING (security_id) WHERE sector <> 'MIDDLE EAST' GROUP BY sector, trade_date"),
    "statements_compacted": sql("statements", "SELECT security_id, fiscal_year, canonical_id, amount FROM statements WHERE fiscal_month = 12 AND statement_type = 'IS'"),
    "dividend_scan": """SELECT 'ok' AS kind, o_custkey % 100 AS stock_code, CAST(year(o_orderdate) AS INTEGER) AS bsns_year, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderkey % 50 <> 0 GROUP BY ALL
        UNION ALL SELECT 'failed', NULL, NULL, count(*), NULL FROM orders WHERE o_orderkey % 50 = 0""",
    "provider_observations": """WITH l AS (SELECT min(CAST(s AS BIGINT)) OVER (PARTITION BY l_orderkey)::VARCHAR AS symbol, ['0q', '+1q', '0y', '+1y'][CAST((l_linenumber - 1) % 4 + 1 AS BIGINT)] AS period, * FROM (SELECT *, l_suppkey AS s FROM lineitem)),
        u AS (SELECT symbol, period, 'avg' AS statistic, l_extendedprice AS value FROM l UNION ALL SELECT symbol, period, 'low', CASE WHEN l_discount > 0 THEN l_discount END FROM l UNION ALL SELECT symbol, period, 'high', l_tax FROM l)
        SELECT symbol, period, statistic, count(*) AS n, round(sum(value), 2) AS total FROM u WHERE value IS NOT NULL GROUP BY 1, 2, 3""",
    "risk_free_rates": RATES,
    "country_premiums": "SELECT n_name AS country, n_nationkey * 0.25::DOUBLE + 3 AS premium, (n_regionkey + 20)::DOUBLE AS tax_rate FROM nation WHERE n_nationkey % 6 <> 0",
    "provider_latest": "SELECT o_custkey % 300 AS ticker, last_day(o_orderdate) AS snapshot_date, o_orderkey, o_totalprice FROM orders QUALIFY rank() OVER (PARTITION BY o_custkey % 300 ORDER BY last_day(o_orderdate) DESC) = 1",
    "dividends_by_kind": """SELECT l_suppkey, bsns_year, stock_kind, sum(q) AS dps, count(*) AS n_disclosures FROM (SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS bsns_year, month(l_shipdate) AS m, l_returnflag AS stock_kind, l_quantity AS q FROM lineitem WHERE l_discount >= 0.05
        QUALIFY row_number() OVER (PARTITION BY l_suppkey, year(l_shipdate), month(l_shipdate), l_returnflag ORDER BY l_shipdate DESC, l_orderkey DESC, l_linenumber DESC) = 1) GROUP BY 1, 2, 3""",
    "providers_combined": "SELECT CASE WHEN l_orderkey % 2 = 0 THEN 'A' ELSE 'B' END AS provider, 'SEC_US_' || l_suppkey AS security_id, count(*) AS n, round(sum(l_extendedprice), 2) AS total FROM lineitem WHERE l_linenumber = 1 GROUP BY 1, 2",
    "amounts_by_pattern": f"SELECT p_brand, {_pick('RED|BLUE', chr(39) + 'BS' + chr(39), False)} AS retained, {_pick('GEAR|BOLT', chr(39) + 'BS' + chr(39), True)} AS debt, {_pick('WIDGET', chr(39) + 'CF' + chr(39) + ', ' + chr(39) + 'IS' + chr(39), True)} AS interest FROM ({_PART}) GROUP BY 1",
    "us_fact_accounts": """SELECT p_partkey, ['10-K', '10-Q', '8-K', '10-K/A'][p_partkey % 4 + 1] AS form, CASE WHEN contains(upper(p_type), 'PROMO BRUSHED') THEN 'REVENUE' WHEN contains(upper(p_type), 'SMALL') THEN 'COGS' WHEN contains(upper(p_name), 'RED') THEN 'INVENTORY' WHEN contains(upper(p_name), 'GEAR') THEN 'PPE'
        WHEN contains(upper(p_brand), 'LARGE') THEN 'OTHER_ASSETS' ELSE 'UNMAPPED' END AS canonical_id, CAST(p_partkey % 12 + 1 AS INTEGER) AS fiscal_month FROM part WHERE p_partkey % 4 <> 2""",
    "metric_flags": """SELECT event_id, m AS metric_id, array_to_string(list_transform(string_split(m, '_'), lambda w: upper(w[1]) || w[2:]), ' ') AS metric_name, CASE WHEN starts_with(m, 'derived_') THEN 'derived' ELSE 'reported' END AS value_type,
        coalesce(CASE WHEN user_id % 5 = 0 THEN 'product' END, CASE WHEN user_id % 4 = 0 THEN NULL ELSE 'segment ' || user_id % 7 END, 'company') AS product_name,
        concat_ws(',', CASE WHEN user_id % 3 = 0 THEN 'UNIT_INFERRED' END, CASE WHEN m IN ('shipment_volume', 'capacity', 'utilization_rate') THEN 'QUANTITY_PROXY_USED' END) AS flags
        FROM (SELECT *, CASE event_type WHEN 'view' THEN 'shipment_volume' WHEN 'click' THEN 'capacity' WHEN 'purchase' THEN 'revenue' WHEN 'signup' THEN 'derived_users' WHEN 'error' THEN 'utilization_rate' END AS m FROM events)""",
}
from .rules_quality import SQL as _RULES  # noqa: E402

SQL["classification_review"] = f"SELECT p_partkey, CASE WHEN p_size = 7 THEN 'MANUAL' ELSE code END AS code, CASE WHEN p_size = 7 THEN 'override' ELSE 'rule' END AS source, CASE WHEN p_size = 7 THEN false ELSE coalesce(confidence, 0) < 0.9 END AS needs_review FROM ({_RULES['sector_classify']}) JOIN (SELECT p_partkey, p_size FROM part) USING (p_partkey)"
