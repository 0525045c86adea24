"""Source frames to the library's tables: names, types, identities, one row a key."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.semantics import finite, period_text_end, security_id

#: Column names of price files. Fixed values.
PRICE_NAMES = {"date": "trade_date", "tradedate": "trade_date", "open": "open", "high": "high", "low": "low", "close": "close", "adjclose": "adj_close", "adj_close": "adj_close", "volume": "volume"}


def normalize_prices(raw: DataFrame, country: str, symbol: str = "symbol") -> DataFrame:
    """Rename by known names, drop rows without day or close, and keep one row a security and day (the last by updated_at, if there is one)."""
    known = {c: PRICE_NAMES[k] for c in raw.columns if (k := c.lower().replace(" ", "").replace("_", "")) in PRICE_NAMES or (k := c.lower()) in PRICE_NAMES}
    rows = raw.select(security_id(country, F.col(symbol)).alias("security_id"), *(F.col(c).try_cast("date").alias(n) if n == "trade_date" else finite(F.col(c).try_cast("double")).alias(n) for c, n in known.items()), *(["updated_at"] if "updated_at" in raw.columns else []))
    rows = rows.where("trade_date IS NOT NULL AND close IS NOT NULL")
    newest = [F.desc("updated_at")] if "updated_at" in rows.columns else []
    values = [c for c in rows.columns if c not in ("security_id", "trade_date", "updated_at")]
    w = Window.partitionBy("security_id", "trade_date").orderBy(*newest, *(F.desc(c) for c in values))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def normalize_shares(statements: DataFrame, priority: dict[str, int]) -> DataFrame:
    """Shares outstanding from statement rows: the first account by priority of each period end."""
    rank = F.coalesce(*(F.when(F.col("canonical_id") == k, v) for k, v in priority.items()))
    w = Window.partitionBy("security_id", "period_end").orderBy("_p", "canonical_id")
    rows = statements.withColumn("_p", rank).where(F.col("_p").isNotNull() & (F.col("amount") > 0))
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("security_id", "period_end", F.col("amount").cast("long").alias("shares"))


REPORT = T.StructType([T.StructField(n, T.StringType()) for n in ("report_id", "symbol", "register_date", "office", "writer", "target_price", "period_1", "eps_1", "period_2", "eps_2", "period_3", "eps_3")])


def read_reports(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Analyst reports as JSON: (reports, estimates, rows that are no JSON)."""
    schema = T.StructType([*REPORT.fields, T.StructField("_bad", T.StringType())])
    raw = spark.read.text(path).select(F.from_json("value", schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    good = raw.where("_bad IS NULL")
    number = lambda c: F.regexp_replace(c, ",", "").try_cast("double")
    day = F.col("register_date").try_cast("date")
    reports = good.select("report_id", security_id("KR", "symbol").alias("security_id"), day.alias("as_of_date"), "office", "writer", number("target_price").alias("target_price"))
    slots = F.array(*(F.struct(F.col(f"period_{k}").alias("target_period"), number(f"eps_{k}").alias("estimate_value")) for k in (1, 2, 3)))
    estimates = good.select("report_id", security_id("KR", "symbol").alias("security_id"), day.alias("as_of_date"), F.explode(slots).alias("e")).select("report_id", "security_id", "as_of_date", "e.*", F.lit("EPS").alias("metric_id"))
    return reports, estimates.where(period_text_end("target_period").isNotNull() & F.col("estimate_value").isNotNull()), raw.where("_bad IS NOT NULL").select("_bad")


def with_row_key(rows: DataFrame, columns: list[str], name: str = "row_key") -> DataFrame:
    """A stable key of the given columns, and one row of each key."""
    return rows.withColumn(name, F.sha2(F.concat_ws("\x1f", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256)).dropDuplicates([name])


def catalog(factor_ids: DataFrame) -> DataFrame:
    """Type, unit and direction of each factor id, by its name."""
    f = F.lower("factor_id")
    kind = F.when(f.rlike("^(tr_|ret_|mom|high_|vol_|rsi|macd|na_|ma_)"), "price").when(f.rlike("(per|pbr|psr|pcr|ev_|yield)"), "valuation").when(f.rlike("(growth|yoy|cagr)"), "growth").otherwise("fundamental")
    unit = F.when(f.rlike("(pct|yoy|cagr|growth|yield|margin)"), "percent").when(f.rlike("days"), "days").otherwise("ratio")
    direction = F.when(f.rlike("^(per|pbr|psr|pcr|vol_|ev_to|debt|na_ratio)"), "lower").otherwise("higher")
    return factor_ids.select("factor_id").distinct().select("factor_id", kind.alias("factor_type"), unit.alias("unit"), direction.alias("value_direction"))
