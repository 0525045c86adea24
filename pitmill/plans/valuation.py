"""Multiples of all securities against their own history, venue, industry and market, in one aggregation.

Rows are (security_id, factor_id, basis, trade_date, multiple) with one column for each
level above the security. A row that is a security's newest counts at every level it belongs to, a month's
last row of the history's basis counts for the security itself; both are told by one window. One exact
quantile aggregation over (level, group, factor, basis) gives all statistics, combined before the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.tables import shared_path

QUANTILES = (0.1, 0.25, 0.5, 0.75, 0.9)
#: The bases in the order in which they stand in for a missing one. Fixed values.
BASES = ("annual", "ttm", "quarterly")
OWN = "own"


def basis_order(wanted: str, bases: Sequence[str] = BASES) -> list[str]:
    """The wanted basis first, then the others in their order."""
    return [wanted, *(b for b in bases if b != wanted)]


def _rank(basis: Column, order: Sequence[str]) -> Column:
    """The place of a basis; unknown ones are null and never chosen."""
    return F.nullif(F.array_position(F.array(*map(F.lit, order)), basis), F.lit(0))


def _marked(rows: DataFrame, as_of: date | None) -> DataFrame:
    """Of the known rows with a multiple those that are the newest of their security, factor and basis, or the last of their month, and which they are."""
    known = rows.where("multiple IS NOT NULL")
    if as_of is not None:
        known = known.where(F.col("trade_date") <= F.lit(as_of))
    w = Window.partitionBy("security_id", "factor_id", "basis").orderBy(F.desc("trade_date"))
    later = F.lag("trade_date").over(w)
    told = known.withColumn("_later", later).withColumn("_newest", F.col("_later").isNull())
    return told.withColumn("_month_last", F.col("_newest") | (F.trunc("_later", "month") != F.trunc("trade_date", "month"))).drop("_later").where("_month_last")


def level_statistics(rows: DataFrame, levels: Mapping[str, str], wanted: str = "annual", history: str = "annual", as_of: date | None = None) -> DataFrame:
    """(level, group, factor_id, basis, n, p10 to p90): of each group and factor the first basis in order that has values.

    ``levels``: name -> column; rows without a group are not in that level. The level ``own`` is each
    security's history of month ends, on the basis ``history`` alone.
    """
    return _statistics(_marked(rows, as_of), levels, wanted, history)


def _statistics(marked: DataFrame, levels: Mapping[str, str], wanted: str, history: str) -> DataFrame:
    at = lambda level, group, holds: F.when(holds & F.col(group).isNotNull(), F.struct(F.lit(level).alias("level"), F.col(group).cast("string").alias("group")))
    places = F.array(at(OWN, "security_id", F.col("_month_last") & (F.col("basis") == history)), *(at(name, column, F.col("_newest")) for name, column in levels.items()))
    placed = marked.select("factor_id", "basis", "multiple", F.explode(F.array_compact(places)).alias("p")).select("p.*", "factor_id", "basis", "multiple")
    stats = placed.groupBy("level", "group", "factor_id", "basis").agg(F.count("*").alias("n"), F.percentile("multiple", list(QUANTILES)).alias("q"))
    order = _rank(F.col("basis"), basis_order(wanted))
    best = stats.withColumn("_rank", order).where("_rank IS NOT NULL").groupBy("level", "group", "factor_id").agg(F.min_by(F.struct("basis", "n", "q"), "_rank").alias("b"))
    return best.select("level", "group", "factor_id", "b.basis", "b.n", *(F.col("b.q")[k].alias(f"p{int(q * 100)}") for k, q in enumerate(QUANTILES)))


def valuation(rows: DataFrame, levels: Mapping[str, str], wanted: str = "annual", history: str = "annual", as_of: date | None = None) -> DataFrame:
    """Each security's newest multiple of each factor on the first basis it has, beside the statistics of its levels.

    For each level, ``own`` too: <level>_n, <level>_basis, <level>_p25, _p50 and _p75; null where the level has none.
    """
    path = shared_path(rows.sparkSession, "marked")  # a row a month, which statistics and current values both read
    _marked(rows, as_of).write.parquet(path)
    marked = rows.sparkSession.read.parquet(path)
    stats = _statistics(marked, levels, wanted, history)
    newest = marked.where("_newest").withColumn("_rank", _rank(F.col("basis"), basis_order(wanted))).where("_rank IS NOT NULL")
    groups = list(dict.fromkeys(levels.values()))
    current = newest.groupBy("security_id", "factor_id").agg(F.min_by(F.struct("basis", "multiple", "trade_date", *groups), "_rank").alias("c")).select("security_id", "factor_id", "c.*")
    keys = F.array(F.struct(F.lit(OWN).alias("level"), F.col("security_id").cast("string").alias("group")), *(F.struct(F.lit(k).alias("level"), F.col(c).cast("string").alias("group")) for k, c in levels.items()))
    asked = current.select("security_id", "factor_id", "basis", "multiple", "trade_date", F.explode(keys).alias("k")).select("*", "k.level", "k.group").drop("k")
    met = asked.join(stats.withColumnRenamed("basis", "level_basis"), ["level", "group", "factor_id"], "left")
    of = lambda name, column: F.max(F.when(F.col("level") == name, F.col(column)))
    wide = [of(name, column).alias(f"{name}_{alias}") for name in (OWN, *levels) for column, alias in (("n", "n"), ("level_basis", "basis"), ("p25", "p25"), ("p50", "p50"), ("p75", "p75"))]
    return met.groupBy("security_id", "factor_id", "basis", "multiple", "trade_date").agg(*wide)
