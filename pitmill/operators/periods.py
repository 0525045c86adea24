"""Statements to periods: wide frames, single quarters, trailing sums, repairs and derived accounts."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY = ["security_id", "fiscal_year", "fiscal_month"]


def in_year() -> WindowSpec:
    return Window.partitionBy("security_id", "fiscal_year").orderBy("fiscal_month")


def in_time() -> WindowSpec:
    return Window.partitionBy("security_id").orderBy("fiscal_year", "fiscal_month")


def wide_statements(statements: DataFrame, accounts: list[str]) -> DataFrame:
    """One row a period; of several amounts of an account the one of largest size counts, and the latest report date."""
    rows = statements.where(F.col("canonical_id").isin(accounts) & F.col("amount").isNotNull())
    of = lambda a: F.when(F.col("canonical_id") == a, F.col("amount"))
    largest = lambda a: F.when(F.max(of(a)) >= -F.min(of(a)), F.max(of(a))).otherwise(F.min(of(a)))
    return rows.groupBy(*KEY).agg(F.max("report_date").alias("report_date"), *(largest(a).alias(a) for a in accounts))


def single_quarters(wide: DataFrame, flows: list[str]) -> DataFrame:
    """Cumulated flows to those of a quarter: less the row before in the same year. Balances pass through."""
    return wide.withColumns({c: F.col(c) - F.when(F.row_number().over(in_year()) == 1, 0.0).otherwise(F.lag(c).over(in_year())) for c in flows})


def trailing(quarters: DataFrame, flows: list[str], n: int = 4) -> DataFrame:
    """Sums over the last ``n`` rows where all have a value."""
    w = in_time().rowsBetween(-(n - 1), 0)
    return quarters.withColumns({c: F.when(F.count(c).over(w) == n, F.sum(c).over(w)) for c in flows})


def annual(wide: DataFrame, month: int = 12) -> DataFrame:
    return wide.where(F.col("fiscal_month") == month)


def with_lags(frame: DataFrame, columns: list[str], lags: list[int]) -> DataFrame:
    return frame.withColumns({f"{c}_l{k}": F.lag(c, k).over(in_time()) for c in columns for k in lags})


def with_formulas(frame: DataFrame, formulas: Mapping[str, str], digits: int | None = 6) -> DataFrame:
    """Add columns by SQL expressions; later ones may use earlier ones."""
    for name, text in formulas.items():
        frame = frame.withColumn(name, F.expr(text))
    return frame if digits is None else frame.withColumns({n: F.round(n, digits) for n in formulas})


def derive_missing(wide: DataFrame, identities: list[tuple[str, str]]) -> DataFrame:
    """Fill an account that is missing by an identity; in order, later ones may use earlier results."""
    for account, text in identities:
        wide = wide.withColumn(account, F.coalesce(F.col(account), F.expr(text)))
    return wide


def repair_scale(long: DataFrame, jump: float = 100.0, least: int = 3, share: float = 0.25) -> DataFrame:
    """Divide a period by 1e3 or 1e6 where enough accounts exceed both neighbours by ``jump``.

    ``long``: (security_id, fiscal_year, fiscal_month, canonical_id, amount).
    """
    w = Window.partitionBy("security_id", "canonical_id").orderBy("fiscal_year", "fiscal_month")
    near = F.greatest(F.abs(F.lag("amount").over(w)), F.abs(F.lead("amount").over(w)))
    marked = long.withColumn("_near", near).withColumn("_over", F.try_divide(F.abs("amount"), F.nullif(F.col("_near"), F.lit(0.0))))
    scale: Column = F.when(F.col("_over") > 1e5, 1e6).when(F.col("_over") > jump, 1e3)
    marked = marked.withColumn("_scale", scale)
    votes = marked.groupBy(*KEY).agg(F.count("amount").alias("_n"), F.count("_scale").alias("_hits"), F.min("_scale").alias("_by")).where((F.col("_hits") >= least) & (F.col("_hits") >= share * F.col("_n")))
    out = long.join(votes.select(*KEY, "_by"), KEY, "left")
    return out.withColumn("amount", F.col("amount") / F.coalesce("_by", F.lit(1.0))).withColumn("scaled_by", F.coalesce("_by", F.lit(1.0))).drop("_by")
