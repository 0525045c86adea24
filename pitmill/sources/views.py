"""Finance-shaped views over the driver's tables; each has the same definition as SQL for DuckDB.

A supplier is a security, a nation its industry group, a region its sector; the
lines of a day are its trades; the lines of a quarter its statement, which
becomes known 45 days after the quarter's end.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tables import shared_path

#: Statement items of a quarter: name -> (statement, aggregate over lines). Flows are published cumulated within the year.
ITEMS = {
    "SALE": ("IS", "sum(l_extendedprice * (1 - l_discount))"),
    "COGS": ("IS", "sum(l_extendedprice * (1 - l_discount)) * 0.5 + 0.2 * sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END)"),
    "SGA": ("IS", "0.05 * sum(l_extendedprice) + 0.1 * sum(CASE WHEN l_returnflag = 'A' THEN l_extendedprice ELSE 0 END)"),
    "XINT": ("IS", "0.2 * sum(l_extendedprice * l_discount)"),
    "NI": ("IS", "0.2 * sum(l_extendedprice * (1 - l_discount)) - 0.45 * sum(CASE WHEN l_returnflag = 'R' THEN l_extendedprice ELSE 0 END)"),
    "DP": ("CF", "0.03 * sum(l_extendedprice)"),
    "CFO": ("CF", "0.2 * sum(l_extendedprice) - 0.3 * sum(CASE WHEN l_linestatus = 'O' THEN l_extendedprice * l_tax * 10 ELSE 0 END)"),
    "CAPX": ("CF", "0.8 * sum(l_extendedprice * l_tax)"),
    "DIV": ("CF", "0.1 * sum(CASE WHEN l_returnflag = 'N' THEN l_extendedprice ELSE 0 END)"),
    "TA": ("BS", "2000 * sum(l_quantity) + sum(l_extendedprice)"),
    "SEQ": ("BS", "900 * sum(l_quantity)"),
    "ACT": ("BS", "700 * sum(l_quantity)"),
    "LCT": ("BS", "400 * sum(l_quantity) + 0.2 * sum(l_extendedprice * l_discount)"),
    "RECT": ("BS", "200 * sum(l_quantity) + 100 * count(*)"),
    "INVT": ("BS", "150 * sum(l_quantity)"),
    "CHE": ("BS", "120 * sum(l_quantity)"),
    "PPENT": ("BS", "600 * sum(l_quantity) + 0.1 * sum(l_extendedprice)"),
    "DLTT": ("BS", "300 * sum(l_quantity) + 0.3 * sum(l_extendedprice * l_tax)"),
    "DLC": ("BS", "90 * sum(l_quantity)"),
    "RE": ("BS", "250 * sum(l_quantity) - 0.05 * sum(l_extendedprice)"),
}
FLOWS = [k for k, (kind, _) in ITEMS.items() if kind != "BS"]
STOCKS = [k for k, (kind, _) in ITEMS.items() if kind == "BS"]


def cut(x: Column, digits: int = 2) -> Column:
    """Whole hundredths from below; unlike rounding it has no ties that two engines could break apart."""
    return F.floor(x * 10**digits + 1e-6) / 10**digits


class Folder(str):
    """A folder of tables of which some views have been written already (name -> path), or whose lines are dealt out once, into so many parts (``dealt``)."""

    derived: dict[str, str] = {}
    dealt: int = 0


def derived(view: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """A view that is read where a ``Folder`` has it, and made of the tables otherwise."""

    @functools.wraps(view)
    def reading(spark: SparkSession, sf_dir: str) -> DataFrame:
        path = getattr(sf_dir, "derived", {}).get(view.__name__)
        return spark.read.parquet(path) if path else view(spark, sf_dir)

    return reading


def materialised(spark: SparkSession, sf_dir: str, *views: Callable[[SparkSession, str], DataFrame]) -> Folder:
    """The same folder, with each of the ``views`` written once as a table, so that a plan of many families scans that and not its source."""
    out = Folder(sf_dir)
    out.derived, out.dealt = dict(getattr(sf_dir, "derived", {})), getattr(sf_dir, "dealt", 0)
    for view in views:
        if view.__name__ in out.derived:
            continue
        path = shared_path(spark, view.__name__)
        view(spark, out).write.parquet(path)
        out.derived[view.__name__] = path
    return out


#: Lines of a part of a dealt folder; what is made of them in one task, 2 KB a line or so, fits the memory of a core.
LINES_A_PART = 250_000


def dealt(spark: SparkSession, sf_dir: str) -> Folder:
    """The same folder for a plan of many families: its lines are dealt out by security once, and each security's days, quarters and weeks are made where its lines are.

    Parts follow the number of lines. Spark would merge them by the bytes that it reads, and a part's rows take many times that.
    """
    out = Folder(sf_dir)
    out.derived, out.dealt = dict(getattr(sf_dir, "derived", {})), getattr(sf_dir, "dealt", 0)
    out.dealt = out.dealt or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-read(spark, sf_dir, "lineitem").count() // LINES_A_PART))
    return out


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as trades of a security and day. In a ``dealt`` folder their numbers and flags travel as one array: readers that ask for some columns each would have a shuffle each, so they share one. A line without a supplier is there under an empty name."""
    rows = read(spark, sf_dir, "lineitem").select("*", F.concat(F.lit("SEC_US_"), F.col("l_suppkey").cast("string")).alias("security_id"), F.to_date("l_shipdate").alias("trade_date"))
    if not getattr(sf_dir, "dealt", 0):
        return rows
    flag = lambda c, values: F.coalesce(*(F.when(F.col(c) == v, k) for k, v in enumerate(values, 1)), F.lit(0))
    name = lambda k, values: F.coalesce(*(F.when(k == i, v) for i, v in enumerate(values, 1)), F.lit(""))
    numbers, returned, status = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "RAN", "O"  # the flags that views ask for
    packed = F.array(*numbers, (flag("l_returnflag", returned) + 10 * flag("l_linestatus", status)).cast("double")).alias("_numbers")
    named = F.coalesce("security_id", F.lit("")).alias("security_id")  # never null, so that no join's filter on it comes between a reader and the shuffle
    shared = rows.select(named, "trade_date", packed).repartition(sf_dir.dealt, "security_id")
    of = lambda k: F.get("_numbers", F.lit(k))
    return shared.select("security_id", "trade_date", *(of(k).alias(c) for k, c in enumerate(numbers)), name(of(4) % 10, returned).alias("l_returnflag"), name(F.floor(of(4) / 10), status).alias("l_linestatus"))


def price_days(spark: SparkSession, sf_dir: str, **more: Column) -> DataFrame:
    """``price_daily`` as made of lines, with ``more`` aggregates of a day's lines."""
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    rows = lines(spark, sf_dir)
    rows = rows if getattr(sf_dir, "dealt", 0) else rows.repartition("security_id")
    return rows.groupBy("security_id", "trade_date").agg(
        cut(F.sum("l_extendedprice") / F.sum("l_quantity")).alias("close"),
        cut(F.max(unit)).alias("high"),
        cut(F.min(unit)).alias("low"),
        F.sum("l_quantity").alias("volume"),
        *(c.alias(k) for k, c in more.items()),
    )


@derived
def price_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a security and day: average, highest and lowest unit price, and quantity. Lines are dealt out by security, as all that follows is: one shuffle serves the days and the windows over them."""
    return price_days(spark, sf_dir)


def trading_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days of ``price_daily``, one row a day, without making its prices."""
    if "price_daily" in getattr(sf_dir, "derived", {}):
        return price_daily(spark, sf_dir).select("trade_date").distinct()
    return read(spark, sf_dir, "lineitem").select(F.to_date("l_shipdate").alias("trade_date")).distinct()


def melted(frame: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """As unpivot, but the rows stay dealt out as they were, so that groups within a key need no further shuffle."""
    return frame.select(*keys, F.inline(F.array(*(F.struct(F.lit(c).alias(name), F.col(c).alias(value)) for c in columns))))


def security_master(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    out = read(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return out.select(F.concat(F.lit("SEC_US_"), F.col("s_suppkey").cast("string")).alias("security_id"), F.col("s_name").alias("name"), F.col("n_name").alias("industry_group"), F.col("r_name").alias("sector"), (F.col("r_name") == "MIDDLE EAST").alias("is_financial"), (F.col("s_acctbal") > -500).alias("is_active"))


def shares_monthly(prices: DataFrame) -> DataFrame:
    """Shares known at a month's end: ten times what was traded in the month."""
    return prices.groupBy("security_id", F.last_day("trade_date").alias("known_date")).agg((F.sum("volume") * 10).alias("shares"))


def quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts of single quarters, wide."""
    rows = lines(spark, sf_dir).groupBy("security_id", F.year("trade_date").alias("fiscal_year"), (F.quarter("trade_date") * 3).alias("fiscal_month"))
    return rows.agg(*(cut(F.expr(text)).alias(name) for name, (_, text) in ITEMS.items()))


@derived
def statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As published, long: flows cumulated within the year, and when each row became known."""
    year = Window.partitionBy("security_id", "fiscal_year").orderBy("fiscal_month").rowsBetween(Window.unboundedPreceding, 0)
    wide = quarters(spark, sf_dir).select("security_id", "fiscal_year", "fiscal_month", *(cut(F.sum(c).over(year)).alias(c) for c in FLOWS), *STOCKS)
    rows = melted(wide, ["security_id", "fiscal_year", "fiscal_month"], list(ITEMS), "canonical_id", "amount")
    kind = F.when(F.col("canonical_id").isin(STOCKS), "BS").otherwise(F.when(F.col("canonical_id").isin([k for k, (t, _) in ITEMS.items() if t == "IS"]), "IS").otherwise("CF"))
    end = F.last_day(F.make_date("fiscal_year", "fiscal_month", F.lit(1)))
    return rows.select("security_id", "fiscal_year", "fiscal_month", kind.alias("statement_type"), "canonical_id", "amount", F.date_add(end, 45).alias("report_date"))


def benchmark(prices: DataFrame) -> DataFrame:
    """An index: the average close of a day."""
    return prices.groupBy("trade_date").agg(cut(F.avg("close"), 4).alias("index_close"))


@derived
def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as analyst reports: the clerk's segment and customer stand for broker and analyst, the total price for the estimate."""
    lines = read(spark, sf_dir, "lineitem").where("l_linenumber = 1").select("l_orderkey", F.concat(F.lit("SEC_US_"), F.col("l_suppkey").cast("string")).alias("security_id"))
    orders = read(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return orders.select("security_id", F.concat(F.lit("B"), (F.col("o_custkey") % 7).cast("string")).alias("broker"), F.concat(F.lit("A"), F.col("o_custkey").cast("string")).alias("analyst"), F.to_date("o_orderdate").alias("report_date"), cut(F.col("o_totalprice") / 1000).alias("estimate"), F.col("o_orderkey").alias("report_idx"))


def _cut(x: str, digits: int = 2) -> str:
    return f"(floor(({x}) * 1e{digits} + 1e-6) / 1e{digits})"


_LINES = ",\n".join(f"{_cut(text)} AS \"{name}\"" for name, (_, text) in ITEMS.items())
_FLOWS = ", ".join(_cut(f'sum("{c}") OVER (PARTITION BY security_id, fiscal_year ORDER BY fiscal_month ROWS UNBOUNDED PRECEDING)') + f' AS "{c}"' for c in FLOWS)
_KIND = "CASE " + " ".join(f"WHEN canonical_id IN ({', '.join(repr(k) for k, (t, _) in ITEMS.items() if t == kind)}) THEN '{kind}'" for kind in ("BS", "IS", "CF")) + " END"
#: The same views for DuckDB, in order of dependence.
CTE = {
    "price_daily": f"""SELECT 'SEC_US_' || l_suppkey AS security_id, CAST(l_shipdate AS DATE) AS trade_date,
        {_cut('sum(l_extendedprice) / sum(l_quantity)')} AS close, {_cut('max(l_extendedprice / l_quantity)')} AS high,
        {_cut('min(l_extendedprice / l_quantity)')} AS low, sum(l_quantity) AS volume FROM lineitem GROUP BY 1, 2""",
    "security_master": """SELECT 'SEC_US_' || s_suppkey AS security_id, s_name AS name, n_name AS industry_group, r_name AS sector,
        r_name = 'MIDDLE EAST' AS is_financial, s_acctbal > -500 AS is_active
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "shares_monthly": "SELECT security_id, last_day(trade_date) AS known_date, sum(volume) * 10 AS shares FROM price_daily GROUP BY 1, 2",
    "quarters": f"""SELECT 'SEC_US_' || l_suppkey AS security_id, CAST(year(l_shipdate) AS INTEGER) AS fiscal_year, CAST(quarter(l_shipdate) * 3 AS INTEGER) AS fiscal_month, {_LINES}
        FROM lineitem GROUP BY 1, 2, 3""",
    "published": f"SELECT security_id, fiscal_year, fiscal_month, {_FLOWS}, {', '.join(f'\"{c}\"' for c in STOCKS)} FROM quarters",
    "statements": f"""SELECT security_id, fiscal_year, fiscal_month, {_KIND} AS statement_type, canonical_id, amount,
        last_day(make_date(fiscal_year, fiscal_month, 1)) + 45 AS report_date
        FROM (UNPIVOT published ON {', '.join(f'"{c}"' for c in ITEMS)} INTO NAME canonical_id VALUE amount)""",
    "benchmark_index": f"SELECT trade_date, {_cut('avg(close)', 4)} AS index_close FROM price_daily GROUP BY 1",
    "reports": f"""SELECT 'SEC_US_' || l_suppkey AS security_id, 'B' || (o_custkey % 7) AS broker, 'A' || o_custkey AS analyst,
        CAST(o_orderdate AS DATE) AS report_date, {_cut('o_totalprice / 1000')} AS estimate, o_orderkey AS report_idx
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey AND l_linenumber = 1""",
}
_NEEDS = {"shares_monthly": ["price_daily"], "published": ["quarters"], "statements": ["quarters", "published"], "benchmark_index": ["price_daily"]}


def sql(names: str, body: str, **more: str) -> str:
    """DuckDB text: the named views (and what they need), further CTEs, and the final SELECT."""
    wanted = set(names.split())
    for name in list(wanted):
        wanted.update(_NEEDS.get(name, []))
    parts = [f"{k} AS ({v})" for k, v in CTE.items() if k in wanted] + [f"{k} AS ({v})" for k, v in more.items()]
    return f"WITH {', '.join(parts)} {body}"
