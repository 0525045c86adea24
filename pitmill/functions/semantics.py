"""Scalar rules that all factor operators share.

Missing is NULL: NaN and infinities become NULL when they enter. A quotient
whose divisor is zero or missing is NULL, never an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(x: Column | str) -> Column:
    """NULL for NaN and infinities."""
    x = col(x).cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def divide(a: Column | str, b: Column | str) -> Column:
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def positive(x: Column | str) -> Column:
    """A divisor that must be positive."""
    return F.when(col(x) > 0, col(x))


def nonzero(x: Column | str) -> Column:
    return F.nullif(col(x), F.lit(0.0))


def first_value(*columns: Column | str) -> Column:
    return F.coalesce(*map(col, columns))


def bounded(x: Column | str, reference: Column | str, multiple: float) -> Column:
    """NULL where ``x`` is larger than ``multiple`` times the reference, both taken without sign; no reference, no bound."""
    x, reference = col(x), col(reference)
    return F.when(reference.isNull() | (F.abs(x) <= multiple * F.abs(reference)), x)


def yoy_percent(x: Column, before: Column) -> Column:
    return (divide(x, before) - 1) * 100


def growth_percent(x: Column, before: Column) -> Column:
    """Change over the earlier value's size, so that its sign is the direction of the change."""
    return divide(x - before, F.abs(before)) * 100


def profit_growth_percent(x: Column, before: Column) -> Column:
    """Growth between values of one sign only."""
    return F.when(((x > 0) & (before > 0)) | ((x < 0) & (before < 0)), growth_percent(x, before))


def cagr_percent(x: Column, before: Column, years: float) -> Column:
    return F.when((x > 0) & (before > 0), (F.pow(divide(x, before), F.lit(1.0 / years)) - 1) * 100)


def clip(x: Column, low: float, high: float) -> Column:
    """Between two limits; NULL stays NULL."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def amount_text(text: Column | str) -> Column:
    """A number from a statement's text: blanks and commas go, brackets or a triangle mean a negative amount, a dash means none."""
    bare = F.regexp_replace(col(text), r"[\s,원₩$]", "")
    digits = F.regexp_replace(bare, r"[()△▲−-]", "")
    size = digits.try_cast("double")
    return F.when(bare.rlike(r"^(\(.*\)|[-−△▲].*)$"), -size).otherwise(size)


def unit_factor(text: Column | str) -> Column:
    """Multiplier of a unit text. Fixed values."""
    text = col(text)
    return (
        F.when(text.rlike("조|trillion"), 1e12).when(text.rlike("십억|billion"), 1e9).when(text.rlike("억"), 1e8)
        .when(text.rlike("백만|million"), 1e6).when(text.rlike("천|thousand"), 1e3).otherwise(1.0)
    )


def account_name(text: Column | str) -> Column:
    """An account's name without numbering, brackets and blanks, in lower case."""
    bare = F.regexp_replace(F.lower(col(text)), r"^\s*([ivx]+\.|\d+\.|\(\d+\)|[가-하]\.)\s*", "")
    return F.regexp_replace(F.regexp_replace(bare, r"\(.*?\)|\[.*?\]", ""), r"\s+", "")


def period_end(year: Column, month: Column) -> Column:
    return F.last_day(F.make_date(year, month, F.lit(1)))


def period_text_end(text: Column | str) -> Column:
    """The last day of a period written YYYY.MM; NULL for anything else."""
    text = col(text)
    month = F.substring(text, 6, 2).try_cast("int")
    return F.when(text.rlike(r"^\d{4}\.(0[1-9]|1[0-2])$"), period_end(F.substring(text, 1, 4).try_cast("int"), month))


def security_id(country: str, symbol: Column | str) -> Column:
    """SEC_<COUNTRY>_<symbol>; numeric Korean symbols have six digits."""
    symbol = F.upper(F.trim(col(symbol).cast("string")))
    if country == "KR":
        symbol = F.when(symbol.rlike(r"^\d+$"), F.lpad(symbol, 6, "0")).otherwise(symbol)
    return F.concat(F.lit(f"SEC_{country}_"), symbol)
