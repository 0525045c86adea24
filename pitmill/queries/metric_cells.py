"""Operating metrics from the cells of tables, which the lines of a security's quarter and flag stand for."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.metric_tables import extract_metrics
from ..sources.views import read

UNITS = ["(단위: 백만원)", "(단위: 천원, 천개)", "(단위: 억원)", ""]


def _tables(spark, d):
    """A table a security and quarter, a row a return flag: sold quantity, revenue, price, use of capacity, and columns that are no metrics."""
    g = read(spark, d, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("year"), F.quarter("l_shipdate").alias("quarter"), "l_returnflag")
    g = g.agg(F.sum("l_quantity").cast("long").alias("q"), F.floor(F.sum("l_extendedprice")).cast("long").alias("r"), F.count("*").alias("n"))
    text = lambda c: F.format_number(c, 0)
    cells = F.create_map(
        F.lit("판매량 > 당기"), text("q"), F.lit("매출액"), F.when(F.col("q") % 5 == 0, F.concat(F.lit("△ "), text("r"))).otherwise(text("r")),
        F.lit("평균판매가격 (만원)"), F.when(F.col("n") > 3, F.col("n").cast("string")).otherwise("-"), F.lit("가동률"), F.concat((F.col("q") % 100).cast("string"), F.lit("%")),
        F.lit("매출 비중"), F.lit("12%"), F.lit("제24기 매출액"), text("r"), F.lit("수량"), text("n"),
    )
    unit = F.element_at(F.array(*map(F.lit, UNITS)), (F.col("l_suppkey") % 4 + 1).cast("int"))
    return g.select(
        "l_suppkey", "year", "quarter", "l_returnflag", F.when(F.col("l_suppkey") % 3 == 0, "paragraph_table").otherwise("data_table").alias("table_kind"), unit.alias("unit_text"),
        F.when(F.col("l_suppkey") % 2 == 0, "생산실적").otherwise("현황").alias("caption"),
        F.when(F.col("l_returnflag") == "A", F.array(F.lit("합계"))).when(F.col("l_returnflag") == "N", F.array(F.lit(" "), F.lit("x"))).otherwise(F.array(F.lit("부문 R"), F.lit("제품"))).alias("row_values"),
        F.concat(F.lit("| "), "l_returnflag", F.lit(" |")).alias("row_text"), F.to_json(cells).alias("header_values"),
    )


def metric_cells(spark, d):
    """The metrics of all cells, with unit, amount, entity and confidence."""
    out = extract_metrics(_tables(spark, d))
    return out.select("l_suppkey", "year", "quarter", "l_returnflag", "raw_label", "metric_id", "unit", F.round("amount", 2).alias("amount"), "segment", "product", "confidence")


QUERIES = {"metric_cells": metric_cells}
_ENTITY = "CASE l_returnflag WHEN 'A' THEN '합계' WHEN 'N' THEN 'N' ELSE '부문 R' END AS segment, CASE l_returnflag WHEN 'A' THEN '합계' WHEN 'N' THEN 'N' ELSE '제품' END AS product"
_BASE = "CASE WHEN l_suppkey % 3 = 0 THEN 0.65 ELSE 0.95 END"
SQL = {
    "metric_cells": f"""WITH g AS (
  SELECT l_suppkey, CAST(year(l_shipdate) AS INTEGER) AS year, CAST(quarter(l_shipdate) AS INTEGER) AS quarter, l_returnflag, l_suppkey % 4 AS u, CAST(sum(l_quantity) AS BIGINT) AS q, CAST(floor(sum(l_extendedprice)) AS BIGINT) AS r, count(*) AS n
  FROM lineitem GROUP BY ALL),
c AS (
  SELECT *, '판매량 > 당기' AS raw_label, 'quantity_sold' AS metric_id, 'unit' AS unit, q * CASE WHEN u = 1 THEN 1000.0 ELSE 1.0 END AS amount, {_BASE} AS conf FROM g
  UNION ALL SELECT *, '매출액', 'revenue', CASE WHEN u = 3 THEN 'inferred_KRW' ELSE 'KRW' END, CASE WHEN q % 5 = 0 THEN -1.0 ELSE 1.0 END * r * CASE u WHEN 0 THEN 1e6 WHEN 1 THEN 1e3 WHEN 2 THEN 1e8 ELSE 1.0 END, {_BASE} * CASE WHEN u = 3 THEN 0.7 ELSE 1.0 END FROM g
  UNION ALL SELECT *, '평균판매가격 (만원)', 'reported_asp', 'KRW_PER_UNIT', n * CASE u WHEN 0 THEN 1.0 WHEN 1 THEN 1e3 ELSE 1e4 END, {_BASE} FROM g WHERE n > 3
  UNION ALL SELECT *, '가동률', 'utilization_rate', 'percent', (q % 100)::DOUBLE, {_BASE} * 0.85 FROM g
  UNION ALL SELECT *, '수량', 'quantity_produced', 'unit', n * CASE WHEN u = 1 THEN 1000.0 ELSE 1.0 END, {_BASE} FROM g WHERE l_suppkey % 2 = 0)
SELECT l_suppkey, year, quarter, l_returnflag, raw_label, metric_id, unit, round(amount::DOUBLE, 2) AS amount, {_ENTITY}, round(conf::DOUBLE, 4) AS confidence FROM c"""
}
