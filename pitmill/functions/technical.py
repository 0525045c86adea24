"""Price factors over windows of one security's rows, as Columns over a window ``w`` ordered by day.

All windows count rows, not days, and share one partitioning, so that a table of
all factors costs one shuffle and one sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from .semantics import divide, positive


def security_days() -> WindowSpec:
    """The days of a security in order; every factor's default window."""
    return Window.partitionBy("security_id").orderBy("trade_date")



def rows(w: WindowSpec | None, n: int, skip: int = 0) -> WindowSpec:
    """The last ``n`` rows, or those up to ``skip`` rows ago."""
    return (w or security_days()).rowsBetween(-(n - 1), -skip)


def at_least(x: Column, counted: Column, w: WindowSpec, least: int) -> Column:
    """``x`` where the window holds enough values."""
    return F.when(F.count(counted).over(w) >= least, x)


def moving_average(x: Column, n: int, w: WindowSpec | None = None, least: int | None = None) -> Column:
    frame = rows(w, n)
    return at_least(F.avg(x).over(frame), x, frame, n if least is None else least)


def momentum(price: Column, near: int, far: int, w: WindowSpec | None = None) -> Column:
    """Return from ``far`` to ``near`` rows ago."""
    w = w or security_days()
    return divide(F.lag(price, near).over(w) if near else price, positive(F.lag(price, far).over(w))) - 1


def high_gap(price: Column, n: int = 252, least: int = 20, w: WindowSpec | None = None) -> Column:
    frame = rows(w, n)
    return at_least(divide(price, F.max(price).over(frame)) - 1, price, frame, least)


def skipped_volatility(daily_return: Column, skip: int = 21, n: int = 231, least: int = 60, w: WindowSpec | None = None) -> Column:
    """Annualised deviation of the returns of ``n`` rows that end ``skip`` rows ago."""
    frame = rows(w, n + skip, skip)
    return at_least(F.stddev_samp(daily_return).over(frame) * F.sqrt(F.lit(252.0)), daily_return, frame, least)


def skipped_mean(x: Column, skip: int = 21, n: int = 231, least: int = 60, w: WindowSpec | None = None) -> Column:
    frame = rows(w, n + skip, skip)
    return at_least(F.avg(x).over(frame), x, frame, least)


def with_max_drawdown(prices: DataFrame, daily_return: str = "ret", skip: int = 21, n: int = 231, least: int = 60, name: str = "max_drawdown") -> DataFrame:
    """``prices`` (security_id, trade_date and others) with the largest fall from a running peak within the window, in percent (0 or below).

    A stretch of rows has a summary that two stretches combine: the product of its
    growth, the highest and the lowest product of a beginning, and the worst fall. Blocks of ``n`` rows give each row
    the summary from its block's begin (running aggregates) and up to its block's end
    (the same, from the end). A window of ``n`` rows is the end of one block and the begin of the
    next, so it takes two lookups and no row holds a list. A null return is no change;
    a return of -1 or below, which no product recovers from, makes every window that holds it -100.
    """
    days = security_days()
    lost = F.coalesce(F.col(daily_return) <= -1, F.lit(False))
    out = prices.withColumn("_row", F.row_number().over(days)).withColumn("_block", F.floor((F.col("_row") - 1) / n))
    out = out.withColumn("_g", F.when(lost, 1.0).otherwise(F.coalesce(F.col(daily_return) + 1.0, F.lit(1.0))))
    block = Window.partitionBy("security_id", "_block").orderBy("trade_date")
    begin, end = block.rowsBetween(Window.unboundedPreceding, 0), block.rowsBetween(0, Window.unboundedFollowing)
    out = out.withColumn("_p", F.product("_g").over(begin))
    out = out.withColumn("_before", F.lag("_p", 1, 1.0).over(block))
    out = out.withColumns({"_peak": F.greatest(F.max("_p").over(begin), F.lit(1.0)), "_trough": F.min("_p").over(begin), "_high": F.max("_p").over(end), "_low": F.min("_p").over(end), "_last": F.last("_p").over(end)})
    out = out.withColumn("_from_here", F.least(F.col("_low") / F.col("_before") - 1, F.lit(0.0)))
    out = out.withColumns({"_fall": F.min(F.col("_p") / F.col("_peak") - 1).over(begin), "_fall_after": F.min("_from_here").over(end)})
    counts = {"_values": F.count(daily_return), "_losses": F.sum(lost.cast("int"))}
    out = out.withColumns({k: c.over(days.rowsBetween(Window.unboundedPreceding, 0)) for k, c in counts.items()})
    # up to the window's last row, and from its first to the end of that one's block; one lookup each
    head = F.lag(F.struct("_row", "_trough", "_fall", "_values", "_losses"), skip).over(days)
    tail = F.lag(F.struct((F.col("_last") / F.col("_before")).alias("growth"), F.greatest(F.col("_high") / F.col("_before"), F.lit(1.0)).alias("peak"), F.col("_fall_after").alias("fall")), skip + n - 1).over(days)
    earlier = F.lag(F.struct("_values", "_losses"), skip + n).over(days)
    out = out.withColumns({"_head": head, "_tail": tail, "_earlier": earlier})
    whole = (F.col("_head._row") % n == 0) | F.col("_tail").isNull()  # one block, or the first rows of a security
    across = F.least("_tail.fall", "_head._fall", F.col("_tail.growth") * F.col("_head._trough") / F.col("_tail.peak") - 1)
    worst = F.when(whole, F.col("_head._fall")).otherwise(across)
    within = lambda c: F.col(f"_head.{c}") - F.coalesce(F.col(f"_earlier.{c}"), F.lit(0))
    worst = F.when(within("_losses") > 0, -100.0).otherwise(F.least(worst, F.lit(0.0)) * 100)
    return out.withColumn(name, F.when(within("_values") >= least, worst)).select(*prices.columns, name)


def with_k_ratio(prices: DataFrame, n: int = 756, least: int = 504, price: str = "close", name: str = "k_ratio") -> DataFrame:
    """Slope of log price on the row number, over its standard error times the number of rows.

    The sums of a window are differences of running sums, so a row costs the same
    whatever the window's length. Log prices are taken from the first one on.
    """
    w = security_days()
    running = w.rowsBetween(Window.unboundedPreceding, 0)
    y = F.when(F.col(price) > 0, F.log(price))
    out = prices.withColumn("_y", y).withColumn("_x", F.row_number().over(w).cast("double"))
    out = out.withColumn("_y", F.col("_y") - F.first("_y", True).over(running)).withColumn("_x", F.when(F.col("_y").isNotNull(), F.col("_x")))
    terms = {"k": F.col("_y") * 0 + 1, "x": F.col("_x"), "y": F.col("_y"), "xx": F.col("_x") ** 2, "xy": F.col("_x") * F.col("_y"), "yy": F.col("_y") ** 2}
    out = out.withColumns({f"_c{t}": F.coalesce(F.sum(c).over(running), F.lit(0.0)) for t, c in terms.items()})
    out = out.withColumns({f"_s{t}": F.col(f"_c{t}") - F.lag(f"_c{t}", n, 0.0).over(w) for t in terms})
    k = F.col("_sk")
    centred = lambda a, b: F.col(f"_s{a}{b}") - divide(F.col(f"_s{a}") * F.col(f"_s{b}"), k)
    out = out.withColumns({"_sxx": centred("x", "x"), "_sxy": centred("x", "y"), "_syy": centred("y", "y")}).withColumn("_slope", divide("_sxy", "_sxx"))
    error = F.sqrt(divide(F.greatest(F.col("_syy") - F.col("_slope") * F.col("_sxy"), F.lit(0.0)), (k - 2) * F.col("_sxx")))
    out = out.withColumn(name, F.when(k >= least, divide("_slope", k * F.nullif(error, F.lit(0.0)))))
    return out.select(*prices.columns, name)


def bollinger(price: Column, n: int = 20, width: float = 2.0, w: WindowSpec | None = None) -> tuple[Column, Column, Column]:
    frame = rows(w, n)
    middle, spread = F.avg(price).over(frame), F.stddev_pop(price).over(frame) * width
    return tuple(at_least(x, price, frame, n) for x in (middle - spread, middle, middle + spread))


def williams_r(high: Column, low: Column, close: Column, n: int = 14, w: WindowSpec | None = None) -> Column:
    frame = rows(w, n)
    top, bottom = F.max(high).over(frame), F.min(low).over(frame)
    return at_least(divide(top - close, top - bottom) * -100, close, frame, n)


def flow_multiplier(high: Column, low: Column, close: Column) -> Column:
    return F.coalesce(divide((close - low) - (high - close), high - low), F.lit(0.0))


def chaikin_flow(high: Column, low: Column, close: Column, volume: Column, n: int = 20, w: WindowSpec | None = None) -> Column:
    frame = rows(w, n)
    return at_least(divide(F.sum(flow_multiplier(high, low, close) * volume).over(frame), F.sum(volume).over(frame)), close, frame, n)


def with_money_flow(prices: DataFrame, n: int = 14, name: str = "mfi_14") -> DataFrame:
    """Money flow index; 100 without outflow, 50 without any flow."""
    w, frame = security_days(), rows(None, n)
    typical = (F.col("high") + F.col("low") + F.col("close")) / 3
    out = prices.withColumn("_typical", typical).withColumn("_before", F.lag("_typical").over(w))
    flow = F.col("_typical") * F.col("volume")
    out = out.withColumn("_in", F.when(F.col("_typical") > F.col("_before"), flow).otherwise(0.0)).withColumn("_out", F.when(F.col("_typical") < F.col("_before"), flow).otherwise(0.0))
    gain, loss = F.sum("_in").over(frame), F.sum("_out").over(frame)
    index = F.when((gain == 0) & (loss == 0), 50.0).when(loss == 0, 100.0).otherwise(100 - 100 / (1 + divide(gain, loss)))
    return out.withColumn(name, F.when(F.count("_before").over(frame) >= n, index)).drop("_typical", "_before", "_in", "_out")


def accumulation(high: Column, low: Column, close: Column, volume: Column, w: WindowSpec | None = None) -> Column:
    return F.sum(flow_multiplier(high, low, close) * volume).over((w or security_days()).rowsBetween(Window.unboundedPreceding, 0))


def smoothed(prices: DataFrame, value: str, alphas: dict[str, tuple[float, int]], key: str = "security_id", time: str = "trade_date") -> DataFrame:
    """Exponential means: name -> (alpha, rows needed). The first value is the seed; each mean is a fold in time order.

    The recursion needs all rows of a key in order, so a key's rows are one group;
    a key is one series of days.
    """
    import pandas as pd

    names = list(alphas)

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(time)
        for name, (alpha, least) in alphas.items():
            group[name] = group[value].ewm(alpha=alpha, adjust=False, min_periods=least).mean()
        return group

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prices.schema) + "".join(f", {n} double" for n in names)
    return prices.groupBy(key).applyInPandas(fold, schema)
