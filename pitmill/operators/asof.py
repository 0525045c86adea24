"""As-of joins and snapshots: every value as it was known on a day.

A join is one union of both sides and one window per key: the shuffle is on the
key alone, there is no range join, and rows never meet pairwise. Several tables
join in one such pass. A snapshot keeps of each key the last fact up to each date
and carries it on to the dates that follow, so no spine of keys and dates is joined.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_time: str, right_time: str, *, strict: bool = False, max_age: int | None = None, each: bool = False) -> DataFrame:
    """Add to each left row the columns of the latest right row at or before its time.

    ``strict``: before its time only. ``max_age``: at most so many days before.
    The whole latest row is taken, NULLs included; with ``each`` every column
    takes its own latest value that is not NULL. Of right rows at one time, that
    with the largest values wins.
    """
    values = [c for c in right.columns if c not in by and c != right_time]
    keys = [c for c in left.columns if c not in by]
    carried = F.struct(F.col(right_time).alias("_at"), *values)
    a = left.select(*by, F.col(left_time).alias("_time"), F.lit(0 if strict else 1).alias("_side"), F.struct(*keys).alias("_left"), F.lit(None).cast(_type(right.select(carried.alias("x")), "x")).alias("_right"))
    b = right.select(*by, F.col(right_time).alias("_time"), F.lit(1 if strict else 0).alias("_side"), F.lit(None).cast(_type(a, "_left")).alias("_left"), carried.alias("_right"))
    w = Window.partitionBy(*by).orderBy("_time", "_side", "_right").rowsBetween(Window.unboundedPreceding, 0)
    both = a.unionByName(b.where(F.col("_time").isNotNull()))
    if each:
        found = both.select("*", F.last(F.col("_right._at"), True).over(w).alias("_at"), *(F.last(F.col(f"_right.{c}"), True).over(w).alias(f"_v_{c}") for c in values))
        value = {c: F.col(f"_v_{c}") for c in values}
    else:
        found = both.select("*", F.last("_right", True).over(w).alias("_hit"))
        found = found.withColumn("_at", F.col("_hit._at"))
        value = {c: F.col(f"_hit.{c}") for c in values}
    fresh = F.lit(True) if max_age is None else F.datediff("_time", "_at") <= max_age
    keep = lambda x: F.when(fresh, x)
    return found.where(F.col("_left").isNotNull()).select(*by, "_left.*", keep(F.col("_at")).alias(right_time) if right_time not in left.columns else F.lit(None).alias("_unused"), *(keep(x).alias(c) for c, x in value.items())).drop("_unused")


def asof_joins(left: DataFrame, by: list[str], left_time: str, rights: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """``asof_join`` with several tables at once, each (frame, time): one union, one shuffle and one sort of the left rows for all of them. Columns have different names.

    Where all frames are dealt out by ``by`` already there is no shuffle, and rows stay in order of key and time for windows
    that follow. So a right row without a time is emptied and not filtered: a filter would go down to what the frames share.
    """
    keys = [c for c in left.columns if c not in by and c != left_time] or [left_time]
    rows = left.select(*by, F.col(left_time).alias("_time"), F.lit(1).alias("_side"), F.struct(*keys).alias("_left"))
    values = [[c for c in right.columns if c not in by] for right, _ in rights]
    for k, (right, time) in enumerate(rights):
        ordered = [time, *(c for c in values[k] if c != time)]
        rows = rows.unionByName(right.select(*by, F.col(time).alias("_time"), F.lit(0).alias("_side"), F.when(F.col(time).isNotNull(), F.struct(*ordered)).alias(f"_r{k}")), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_time", "_side", *(f"_r{k}" for k in range(len(rights)))).rowsBetween(Window.unboundedPreceding, 0)
    found = rows.select(*by, "_time", "_left", *(F.last(f"_r{k}", True).over(w).alias(f"_r{k}") for k in range(len(rights)))).where(F.col("_left").isNotNull())
    own = (F.col("_time").cast(left.schema[c].dataType).alias(c) if c == left_time else F.col(f"_left.{c}") for c in left.columns if c not in by)
    return found.select(*by, *own, *(F.col(f"_r{k}.{c}").alias(c) for k in range(len(rights)) for c in values[k]))


def _type(df: DataFrame, name: str) -> str:
    return df.schema[name].dataType.simpleString()


def latest_version(df: DataFrame, keys: list[str], version: Column | str, tie: list[str] | None = None) -> DataFrame:
    """The row with the newest version of each key."""
    w = Window.partitionBy(*keys).orderBy(F.desc(version) if isinstance(version, str) else version.desc(), *(F.desc(t) for t in tie or []))
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def snapshot(facts: DataFrame, dates: DataFrame, keys: list[str], time: str = "trade_date", max_age: int | None = None) -> DataFrame:
    """Every key's latest fact on each of the (few) ``dates``; the day it was observed is ``source_trade_date``.

    A day belongs to the first date at or after it. Of each key and date's days the last fact is kept, which combines
    before a shuffle, and counts at the dates from there to the key's next one. Of facts of one day, that with the largest values wins.
    """
    values = [c for c in facts.columns if c not in keys and c != time]
    ordered = dates.where(F.col(time).isNotNull()).agg(F.array_sort(F.collect_set(F.col(time).cast("date"))).alias("_dates")).where("size(_dates) > 0")
    begin = F.when(F.col("_k") == 0, F.col("_date")).otherwise(F.date_add(F.get("_dates", F.col("_k") - 1), 1))
    calendar = ordered.select("_dates", F.posexplode("_dates").alias("_k", "_date")).select("_k", F.explode(F.sequence(begin, "_date")).alias("_day"))
    known = facts.where(F.col(time).isNotNull()).crossJoin(F.broadcast(ordered)).withColumn("_day", F.greatest(F.col(time).cast("date"), F.get("_dates", F.lit(0)))).drop("_dates")
    last = known.join(F.broadcast(calendar), "_day").groupBy(*keys, "_k").agg(F.max(F.struct(F.col(time).alias("source_trade_date"), *values)).alias("_fact"))
    last = last.select(*keys, "_k", "_fact.*")  # before the explode: Spark 4.1 loses all but one of the fields that are read above it where others are not
    until = F.lead("_k").over(Window.partitionBy(*keys).orderBy("_k"))
    held = last.withColumn("_until", until).crossJoin(F.broadcast(ordered))
    dated = F.explode(F.slice("_dates", F.col("_k") + 1, F.coalesce("_until", F.size("_dates")) - F.col("_k")))
    out = held.select(*keys, dated.alias(time), "source_trade_date", *values)
    return out if max_age is None else out.where(F.datediff(time, "source_trade_date") <= max_age)


def carry_forward(today: DataFrame, previous: DataFrame, keys: list[str]) -> DataFrame:
    """Today's rows, and yesterday's snapshot rows that today did not refresh."""
    return today.unionByName(previous.join(today.select(*keys).distinct(), keys, "left_anti").select(today.columns))


def month_ends(days: DataFrame, time: str = "trade_date") -> DataFrame:
    """The last trading day of each month."""
    return days.groupBy(F.trunc(time, "month").alias("_m")).agg(F.max(time).alias(time)).select(time)
