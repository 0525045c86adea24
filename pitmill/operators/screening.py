"""Peer groups, scores and screens over long factor rows (trade_date, security_id, factor_id, factor_value)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cross_section import percentile_of_rank, robust_z
from ..functions.semantics import divide
from ..sources.tables import shared_path

DAY_FACTOR = ["trade_date", "factor_id"]


def peer_levels(values: DataFrame, group: str, sector: str, group_least: int, sector_least: int, financial: str = "is_financial", rows: str | None = None) -> DataFrame:
    """Add level and peer_code: the group if large enough, else the sector, else all; financials have their own group. A row stands for as many as its column ``rows`` tells."""
    size = lambda *by: (F.sum(rows) if rows else F.count("*")).over(Window.partitionBy(*DAY_FACTOR, financial, *by))
    level = F.when(F.col(financial), "financial").when(size(group) >= group_least, "group").when(size(sector) >= sector_least, "sector").otherwise("all")
    out = values.withColumn("level", level)
    return out.withColumn("peer_code", F.when(F.col("level") == "group", F.col(group)).when(F.col("level") == "sector", F.col(sector)).otherwise(F.col("level")))


def factor_scores(values: DataFrame, group: str = "industry_group", sector: str = "sector", group_least: int = 20, sector_least: int = 10, least: int = 5, winsor: tuple[float, float] = (0.05, 0.95), lower_better: Sequence[str] = ()) -> DataFrame:
    """Winsorized value, percentile score, robust z and peers of each factor value.

    The statistics of a level are those of everyone in the level's group, whichever
    level its members were themselves assigned to: values are laid out once a level that
    any member of the group was assigned to, and each security keeps the row of its own level.
    """
    spark = values.sparkSession
    path = shared_path(spark, "scored")
    values.write.parquet(path)  # the sizes, three aggregates and the ranks read it
    values = spark.read.schema(values.schema).parquet(path)
    cell = [*DAY_FACTOR, "is_financial", group, sector]
    cells = peer_levels(values.groupBy(*cell).agg(F.count("*").alias("_rows")), group, sector, group_least, sector_least, rows="_rows")
    some = lambda level, *by: F.max(F.col("level") == level).over(Window.partitionBy(*DAY_FACTOR, "is_financial", *by))
    laid = lambda test, at, code: F.when(test, F.struct(F.lit(at).alias("at"), code.alias("code")))
    choices = F.array_compact(F.array(laid(F.col("level") == "financial", "financial", F.lit("financial")), laid(F.col("level") == "group", "group", F.col(group)), laid(some("sector", sector), "sector", F.col(sector)), laid(some("all"), "all", F.lit("all"))))
    cells = cells.select(*(F.col(c).alias(f"_{c}") for c in cell), "level", "peer_code", choices.alias("_c"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in cell]
    # the cells, and the statistics of groups, are as many as days and groups, however many securities there are
    rows = values.join(F.broadcast(cells), same).drop(*(f"_{c}" for c in cell)).withColumn("_c", F.explode("_c")).withColumns({"at": F.col("_c.at"), "code": F.col("_c.code")}).drop("_c")
    by = [*DAY_FACTOR, "at", "code"]

    def told(rows: DataFrame, **statistics: Column) -> DataFrame:
        of = rows.groupBy(*by).agg(*(x.alias(c) for c, x in statistics.items())).withColumnsRenamed({c: f"_{c}" for c in by})
        return rows.join(F.broadcast(of), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]).drop(*(f"_{c}" for c in by))

    rows = told(rows, q=F.percentile("factor_value", [winsor[0], winsor[1]]), n_peers=F.count("factor_value"), _n=F.count("*"))
    rows = rows.withColumn("winsorized", F.greatest(F.col("q")[0], F.least(F.col("q")[1], "factor_value"))).drop("q")
    rows = told(rows, median=F.percentile("winsorized", 0.5))
    rows = told(rows, mad=F.percentile(F.abs(F.col("winsorized") - F.col("median")), 0.5))
    value = F.col("winsorized")
    turned = F.when(F.col("factor_id").isin(list(lower_better)), -value).otherwise(value) if lower_better else value
    w = Window.partitionBy(*by).orderBy(F.col("_turned").asc_nulls_last())
    rows = rows.withColumn("_turned", turned).withColumn("score", percentile_of_rank(F.col("_turned"), F.rank().over(w), F.count("*").over(w.rangeBetween(0, 0)), F.col("_n")))
    rows = rows.where(F.col("at") == F.col("level")).withColumn("robust_z", robust_z(value, F.col("median"), F.col("mad")))
    return rows.withColumn("confidence", F.when(F.col("n_peers") < least, 0.25).otherwise(1.0)).drop("_turned", "_n", "at", "code")


def weighted_scores(scores: DataFrame, weights: DataFrame, name: str = "style") -> DataFrame:
    """Weighted mean of the factors at hand, the share of the weight they have, and what is missing.

    ``weights``: (name, factor_id, weight), a small table of parameters.
    """
    total = weights.groupBy(name).agg(F.sum("weight").alias("_total"), F.array_sort(F.collect_set("factor_id")).alias("_all"))
    have = scores.where("score IS NOT NULL").join(F.broadcast(weights), "factor_id").groupBy("trade_date", "security_id", name)
    out = have.agg(divide(F.sum(F.col("weight") * F.col("score")), F.sum("weight")).alias("score"), F.sum("weight").alias("_have"), F.collect_set("factor_id").alias("_ids")).join(F.broadcast(total), name)
    return out.withColumn("confidence", divide("_have", "_total")).withColumn("missing", F.concat_ws(",", F.array_except("_all", "_ids"))).drop("_have", "_total", "_all", "_ids")


def top_percent(value: Column, by: list[str], percent: float, high: bool = True, tie: str = "security_id") -> Column:
    """Whether a row is among the top (or bottom) percent of its group: rank at most max(1, ceil(n p / 100))."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(value.desc() if high else value.asc(), tie))
    n = F.count(value).over(Window.partitionBy(*by))
    return rank <= F.greatest(F.lit(1), F.ceil(n * percent / 100))


def screen(values: DataFrame, conditions: Sequence[dict], match_all: bool = True) -> DataFrame:
    """Securities that meet all, or any, conditions on a day.

    A condition is {factor_id, op, value[, high]}; op is one of > >= < <= = != between top_percent.
    """
    rows = values.where(F.col("factor_id").isin(sorted({c["factor_id"] for c in conditions})) & F.col("factor_value").isNotNull())
    v = F.col("factor_value")
    if any(c["op"] == "top_percent" for c in conditions):
        of = Window.partitionBy("trade_date", "factor_id")
        place = {"_down": F.row_number().over(of.orderBy(v.desc(), "security_id")), "_up": F.row_number().over(of.orderBy(v.asc(), "security_id"))}
        rows = rows.withColumns(place | {"_n": F.count("*").over(of)})

    def met(c: dict) -> Column:
        if c["op"] == "top_percent":
            return F.col("_down" if c.get("high", True) else "_up") <= F.greatest(F.lit(1), F.ceil(F.col("_n") * c["value"] / 100))
        if c["op"] == "between":
            return v.between(*c["value"])
        return {">": v > c["value"], ">=": v >= c["value"], "<": v < c["value"], "<=": v <= c["value"], "=": v == c["value"], "!=": v != c["value"]}[c["op"]]

    # a row has one factor, so all conditions are told in one pass over the rows
    concerns = [F.col("factor_id") == c["factor_id"] for c in conditions]
    matched = sum((F.when(about & met(c), 1).otherwise(0) for about, c in zip(concerns, conditions, strict=True)), F.lit(0))
    found = rows.withColumn("_met", matched).groupBy("trade_date", "security_id").agg(F.sum("_met").alias("n_matched"), *(F.max(F.when(about, v)).alias(f"value_{k}") for k, about in enumerate(concerns)))
    return found.where(F.col("n_matched") >= (len(conditions) if match_all else 1))


#: Bases in order of preference. Fixed values.
BASES = ["ttm", "annual", "quarterly"]


def basis_fallback(rows: DataFrame, key: list[str], wanted: str | None = None) -> DataFrame:
    """One row a key: the wanted basis, else ttm, annual, quarterly, else any; of equal ones the newest."""
    order = ([wanted] if wanted else []) + BASES
    rank = F.coalesce(*(F.when(F.col("financial_basis") == b, k) for k, b in enumerate(order)), F.lit(len(order)))
    w = Window.partitionBy(*key).orderBy(rank, F.desc("updated_at"), "financial_basis")
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def mark_validity(values: DataFrame, limits: DataFrame, strict: bool = False) -> DataFrame:
    """Add is_missing, is_valid and invalid_reason; values out of their factor's limits are named and, unless ``strict``, stay valid.

    ``limits``: (factor_id, lower, upper), a table of parameters.
    """
    v = F.col("factor_value")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    out = values.join(F.broadcast(limits), "factor_id", "left")
    off = F.coalesce((v < F.col("lower")) | (v > F.col("upper")), F.lit(False))
    reason = F.when(v.isNull(), "MISSING").when(off, "OUT_OF_RANGE").when(~finite, "NON_FINITE").otherwise("")
    return out.withColumn("is_missing", v.isNull()).withColumn("is_valid", finite & ~off if strict else finite).withColumn("invalid_reason", reason).drop("lower", "upper")


def winsorize_by_factor(values: DataFrame, by: list[str], quantiles: DataFrame, default: tuple[float, float]) -> DataFrame:
    """Keep values between their group's quantiles, which depend on the factor; ``quantiles``: (factor_id, low_q, high_q), a table of parameters."""
    own = {r.factor_id: (r.low_q, r.high_q) for r in quantiles.collect()}
    every = sorted({*default, *(q for pair in own.values() for q in pair)})
    place = lambda k: F.coalesce(*(F.when(F.col("factor_id") == f, every.index(pair[k])) for f, pair in own.items()), F.lit(every.index(default[k])))
    q = F.percentile("factor_value", every).over(Window.partitionBy(*by))
    out = values.withColumn("_q", q).withColumn("_low", F.get("_q", place(0))).withColumn("_high", F.get("_q", place(1)))
    out = out.withColumn("winsorized", F.greatest("_low", F.least("_high", "factor_value"))).withColumn("is_winsorized", (F.col("factor_value") < F.col("_low")) | (F.col("factor_value") > F.col("_high")))
    return out.drop("_q", "_low", "_high")


def style_detail(scores: DataFrame, marks: DataFrame, weights: DataFrame, core: dict[str, list[str]]) -> DataFrame:
    """Style scores over the factors at hand, with confidence and the ids that are missing or invalid; without all its ``core`` factors a style has no score."""
    every = scores.select("trade_date", "security_id").distinct().crossJoin(F.broadcast(weights))
    rows = every.join(scores, ["trade_date", "security_id", "factor_id"], "left").join(marks, ["trade_date", "security_id", "factor_id"], "left")
    have = F.col("score").isNotNull()
    listed = lambda test: F.array_join(F.array_sort(F.collect_set(F.when(test, F.col("factor_id")))), ",")
    out = rows.groupBy("trade_date", "security_id", "style").agg(
        divide(F.sum(F.col("weight") * F.col("score")), F.sum(F.when(have, F.col("weight")))).alias("score"),
        divide(F.coalesce(F.sum(F.when(have, F.col("weight"))), F.lit(0.0)), F.sum("weight")).alias("confidence"),
        listed(~have).alias("missing"), listed(~F.col("is_valid")).alias("invalid"),
    )
    lacks = F.lit(False)
    for style, ids in core.items():
        lacks = lacks | ((F.col("style") == style) & F.arrays_overlap(F.split("missing", ","), F.array(*map(F.lit, ids))))
    return out.withColumn("score", F.when(~lacks, F.col("score")))


def breakdown(scores: DataFrame, weights: DataFrame) -> DataFrame:
    """Each factor's share of its style's weight at hand, and its part of the score."""
    rows = scores.where("score IS NOT NULL").join(F.broadcast(weights), "factor_id")
    share = divide("weight", F.sum("weight").over(Window.partitionBy("trade_date", "security_id", "style")))
    return rows.withColumn("share", share).withColumn("part", F.col("score") * F.col("share"))


def page(rows: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """A page of ordered rows, with each one's place and the number of all rows, which is counted apart."""
    counted = rows.agg(F.count("*").alias("n_all"))
    part = rows.orderBy(*order).offset(offset).limit(limit)
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(*order)) + offset  # over a page only
    return part.withColumn("place", place).crossJoin(F.broadcast(counted))


def placed(rows: DataFrame, order: Sequence[Column]) -> DataFrame:
    """All rows in order, with each one's place and the number of all rows. Sorted parts are written once; a part's places go on where those of the parts before it end."""
    spark = rows.sparkSession
    path = shared_path(spark, "placed")
    rows.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    part = F.shiftright("_at", 33)
    out = spark.read.parquet(path)
    ends = out.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    parts = Window.partitionBy(F.lit(0))  # one row a part
    starts = ends.select("_part", (F.sum("_n").over(parts.orderBy("_part")) - F.col("_n")).alias("_start"), F.sum("_n").over(parts).alias("n_all"))
    out = out.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return out.withColumn("place", (F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1).cast("int")).drop("_at", "_part", "_start")


def top_k(rows: DataFrame, value: str, k: int, tie: str = "security_id") -> DataFrame:
    """The k largest values, ties by id, with rank and the number of all rows."""
    return page(rows, [F.desc_nulls_last(value), F.asc(tie)], 0, k).select(F.col("place").alias("rank"), tie, value, "n_all")


def canonical_ids(names: Sequence[str], aliases: dict[str, str]) -> list[str]:
    """Factor ids for names as people write them: case, blanks and deltas do not count, and aliases are resolved."""
    plain = [n.strip().lower().replace("δ", "d").replace(" ", "_") for n in names]
    return [aliases.get(n, n) for n in plain]


def impute_zero(value: str, sector: Column, allowed: Sequence[str], intensive: Sequence[str], evidence: Sequence[str]) -> tuple[Column, Column]:
    """Zero for a missing value where the sector allows it and there is evidence of operations; and whether that was done."""
    some = F.coalesce(*evidence).isNotNull()
    done = F.col(value).isNull() & some & F.coalesce(sector.isin(list(allowed)) & ~sector.isin(list(intensive)), F.lit(False))
    return F.when(done, 0.0).otherwise(F.col(value)), done


def index_premium(prices: DataFrame, rates: DataFrame, years: float = 2.0) -> DataFrame:
    """(market, expected, premium): the yearly return of each market's index over its last ``years``, and what it exceeds the market's rate by."""
    last = F.max("trade_date").over(Window.partitionBy("market"))
    seen = prices.withColumn("_last", last).where(F.col("trade_date") >= F.date_sub("_last", int(years * 365)))
    ends = seen.groupBy("market").agg(F.max_by("close", "trade_date").alias("b"), F.min_by("close", "trade_date").alias("a"), F.datediff(F.max("trade_date"), F.min("trade_date")).alias("days"))
    expected = (F.pow(divide("b", "a"), divide(F.lit(365.25), "days")) - 1) * 100
    return ends.withColumn("expected", expected).join(rates, "market").withColumn("premium", F.col("expected") - F.col("rate"))


def eligible(rows: DataFrame, subtypes: Sequence[str], classes: Sequence[str], floors: DataFrame) -> DataFrame:
    """Active securities of the given share classes and none of the subtypes (nor names that say so), above their country's floors.

    ``floors``: (country, least_mcap, least_traded), a table of parameters.
    """
    named = F.col("name").rlike(r"\b(" + "|".join(subtypes) + r")\b")
    kept = rows.where(F.col("is_active") & F.col("share_class").isin(list(classes)) & ~F.col("asset_subtype").isin(list(subtypes)) & ~named)
    return kept.join(F.broadcast(floors), "country").where("mcap >= least_mcap AND traded >= least_traded").drop("least_mcap", "least_traded")
