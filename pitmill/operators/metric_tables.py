"""Operating metrics from table rows: each cell, with its header's label, becomes a metric by keyword rules.

Rows have table_kind, unit_text and caption of their table, row_values (texts of the row, the first of which name
segment and product), row_text, and header_values, a map from header path ("head > rest") to the cell's text,
as JSON or as a map. Everything is Column expressions over the exploded cells; rules
are parameters. Cells without a number, of excluded labels or of earlier periods give nothing.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keywords of Korean filings, first match wins.
#: By the head of the label.
BY_LABEL = [
    ("reported_unit_cost", ["단위당원가", "원가단가", "unitcost"]),
    ("reported_asp", ["판매가격", "평균판매가격", "가격변동", "요금", "asp"]),
    ("quantity_sold", ["판매량", "판매수량", "출하량", "공급량", "판매대수"]),
    ("quantity_produced", ["생산량", "생산실적"]),
    ("capacity", ["생산능력", "capa", "설비능력"]),
    ("utilization_rate", ["가동률", "평균가동률"]),
    ("revenue", ["매출", "영업수익", "판매금액", "금액"]),
]
#: By the whole label, the caption and the row, where the label's head says nothing.
BY_CONTEXT = [
    ("quantity_sold", ["판매량", "판매수량", "출하량", "공급량", "판매대수"]),
    ("quantity_produced", ["생산량", "생산실적"]),
    ("capacity", ["생산능력", "capa", "설비능력"]),
    ("utilization_rate", ["가동률", "평균가동률"]),
    ("reported_asp", ["판매가격", "평균판매가격", "가격변동", "요금", "asp"]),
    ("reported_unit_cost", ["단위당원가", "원가단가", "unitcost"]),
]
AMOUNT_LABELS, SALES_CONTEXT = ["금액", "amount"], ["매출", "영업수익"]
EXCLUDED = ["비중", "구성비", "ratio", "영업이익", "총자산", "매입", "내부거래", "소계", "주요매입처"]
CURRENT_PERIOD = ["분기", "반기", "당기", "현재", "누적"]
TOTALS = ["합계", "총계", "소계", "total"]
#: Units of money, and of counts, with what they multiply by.
MONEY = [("억원", 100_000_000), ("백만원", 1_000_000), ("천원", 1_000)]
PRICES = [("천원", 1_000)]
COUNTED = ["개", "대", "톤", "명", "매", "본"]
# End of the fixed values.


#: What \\s matches.
BLANKS = " \t\n\x0b\f\r"


def compact(text: Column) -> Column:
    return F.lower(F.translate(F.coalesce(text, F.lit("")), BLANKS, ""))


def _any(text: Column, tokens: Sequence[str]) -> Column:
    return reduce(or_, (F.contains(text, F.lit(token)) for token in tokens))


def _first(text: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """The name of the first rule of which a token is in the text; null if none."""
    return F.coalesce(*(F.when(_any(text, tokens), name) for name, tokens in rules))


def metric_of(label: Column, context: Column) -> Column:
    return _metric(compact(F.substring_index(label, ">", 1)), compact(label), compact(context))


def _metric(head: Column, whole: Column, near: Column, both: Column | None = None) -> Column:
    """Of compact texts."""
    by_context = F.coalesce(_first(F.concat_ws(" ", whole, near) if both is None else both, BY_CONTEXT), F.when(_any(whole, AMOUNT_LABELS) & _any(near, SALES_CONTEXT), "revenue"))
    return F.when(~_any(head, EXCLUDED), F.coalesce(_first(head, BY_LABEL), F.when(~_any(whole, EXCLUDED), by_context)))


def number_of(text: Column) -> Column:
    """The first number of a text, with thousands separators; a triangle before it is a minus. Null for none, "-" and "N/A"."""
    return _number(text, _digits(text))


def _digits(text: Column) -> Column:
    return F.regexp_extract(F.trim(text), r"[△▲+-]?\s*\d[\d,]*(?:\.\d+)?", 0)


def _number(text: Column, found: Column) -> Column:
    size = F.translate(found, "△▲+," + BLANKS, "").try_cast("double")
    return F.when(F.trim(text).isin("-", "N/A"), None).otherwise(F.when(F.startswith(found, F.lit("△")) | F.startswith(found, F.lit("▲")), -size).otherwise(size))


def scaled(metric: Column, value: Column, unit_text: Column, label: Column) -> Column:
    """struct(unit, amount): amounts of money and counts in whole units; "inferred_" where no unit was told."""
    source = F.concat_ws(" ", unit_text, label)
    return _scaled(metric, value, source, compact(source))


def _scaled(metric: Column, value: Column, source: Column, told: Column) -> Column:
    of = lambda unit, factor: F.struct(F.lit(unit).alias("unit"), (value * F.lit(float(factor))).alias("amount"))
    has = lambda *tokens: _any(told, tokens)
    ladder = lambda units, name: [F.when(has(token), of(name, factor)) for token, factor in units]
    money = F.coalesce(*ladder(MONEY, "KRW"), of("inferred_KRW", 1))
    price = F.coalesce(*ladder(PRICES, "KRW_PER_UNIT"), F.when(has("만원") & ~has("백만원"), of("KRW_PER_UNIT", 10_000)), of("KRW_PER_UNIT", 1))
    counted = F.coalesce(F.when(has("gwh"), of("MWh", 1_000)), F.when(has("mwh"), of("MWh", 1)), F.when(has(*(f"천{u}" for u in COUNTED)), of("unit", 1_000)), F.when(has(*(f"백만{u}" for u in COUNTED)), of("unit", 1_000_000)), F.when(F.contains(source, F.lit("%")), of("percent", 1)), of("unit", 1))
    return F.when(metric == "utilization_rate", of("percent", 1)).when(metric == "revenue", money).when(metric.isin("reported_asp", "reported_unit_cost", "derived_unit_cost"), price).otherwise(counted)


def confidence_of(metric: Column, table_kind: Column, unit: Column) -> Column:
    base = F.when(table_kind == "data_table", 0.95).otherwise(0.65)
    return F.round(base * F.when(F.startswith(unit, F.lit("inferred")), 0.70).otherwise(1.0) * F.when(metric.isin("capacity", "utilization_rate"), 0.85).otherwise(1.0), 4)


def extract_metrics(rows: DataFrame) -> DataFrame:
    """One row a cell that holds a metric: the input's columns but for header_values, and col_idx, raw_label, raw_value, metric_id, unit, amount, segment, product, confidence."""
    cells = F.col("header_values")
    if rows.schema["header_values"].dataType.simpleString() == "string":
        cells = F.coalesce(F.from_json(cells, "map<string,string>"), F.create_map().cast("map<string,string>"))
    given = lambda k: F.nullif(F.trim(F.get("row_values", F.lit(k))), F.lit(""))
    row_texts = F.filter(F.transform(F.split(F.coalesce("row_text", F.lit("")), r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    out = rows.withColumns({"_texts": row_texts, "_given": given(0), "_cells": F.map_entries(cells)}).drop("header_values")
    out = out.withColumn("segment", F.coalesce("_given", F.get("_texts", F.lit(0)), F.lit("")))
    product = F.coalesce(F.when(F.col("_given").isNotNull(), given(1)).otherwise(F.get("_texts", F.lit(1))), F.nullif("segment", F.lit("")), F.lit("company"))
    out = out.withColumn("product", F.when(_any(compact(F.col("segment")), TOTALS), F.col("segment")).otherwise(product)).drop("_texts", "_given")
    # outer, as Spark else parses the JSON again for a filter of its own; a row without cells has no number and goes below
    out = out.select("*", F.posexplode_outer("_cells").alias("col_idx", "_cell")).drop("_cells")
    out = out.withColumn("raw_label", F.col("_cell.key")).withColumn("raw_value", F.col("_cell.value")).drop("_cell")
    texts = {"_head": compact(F.substring_index("raw_label", ">", 1)), "_whole": compact(F.col("raw_label")), "_near": compact(F.concat_ws(" ", "caption", "unit_text", "row_text")), "_found": _digits(F.col("raw_value")), "_source": F.concat_ws(" ", "unit_text", "raw_label")}
    out = out.withColumns(texts).withColumns({"_both": F.concat_ws(" ", "_whole", "_near"), "_told": compact(F.col("_source"))})  # each text once a cell, whatever number of rules reads it
    earlier = F.contains(F.col("_whole"), F.lit("제")) & F.col("_whole").rlike(r"제\d+기") & ~_any(F.col("_whole"), CURRENT_PERIOD)
    metric = F.when(~earlier, _metric(*map(F.col, ("_head", "_whole", "_near", "_both"))))
    cell = F.struct(metric.alias("metric_id"), _number(F.col("raw_value"), F.col("_found")).alias("_v"))
    out = out.select("*", F.inline(F.array(cell))).where("metric_id IS NOT NULL AND _v IS NOT NULL")  # the rules run below the filter, once
    out = out.withColumn("_s", _scaled(*map(F.col, ("metric_id", "_v", "_source", "_told")))).drop("_head", "_whole", "_near", "_found", "_source", "_both", "_told")
    out = out.withColumn("unit", F.col("_s.unit")).withColumn("amount", F.col("_s.amount"))
    out = out.withColumn("confidence", confidence_of(F.col("metric_id"), F.col("table_kind"), F.col("unit"))).drop("_v", "_s")
    last = ["segment", "product", "confidence"]
    return out.select(*(c for c in out.columns if c not in last), *last)
