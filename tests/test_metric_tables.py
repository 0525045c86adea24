import json

from pyspark.sql import functions as F

from pitmill.operators import metric_tables as m

COLUMNS = "k int, table_kind string, unit_text string, caption string, row_values array<string>, row_text string, header_values string"


def test_numbers_and_metrics(spark):
    texts = ["1,234.5", "△ 20", "▲3.5", "-7", "+8%", "-", "N/A", "none", "", None, "약 12 개"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", m.number_of(F.col("t")).alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == [1234.5, -20.0, -3.5, -7.0, 8.0, None, None, None, None, None, 12.0]
    labels = [("매출액 > 당기", ""), ("매출 비중", ""), ("합 계 > 판매량", ""), ("수출", "판 매 량"), ("Amount", "매출 현황"), ("Amount", "현황"), ("CAPA", ""), ("수출 > 구성비", "판매량")]
    got = spark.createDataFrame([(i, *x) for i, x in enumerate(labels)], "i int, a string, b string").select("i", m.metric_of(F.col("a"), F.col("b")).alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == ["revenue", None, "quantity_sold", "quantity_sold", "revenue", None, "capacity", None]


def test_cells_with_units_entities_and_bad_json(spark):
    cell = lambda **c: json.dumps(c, ensure_ascii=False)
    rows = [
        (1, "data_table", "백만원", "", ["반도체", "DRAM"], "", cell(매출액="10", 제23기="9", 제24기당기매출="8")),
        (2, "other", None, "", [], " | 소계 | x", cell(매출액="10")),
        (3, "data_table", "GWh", "발전", None, "", cell(공급량="2", 가동률="90%")),
        (4, "data_table", "", "", ["a"], "", "{broken"),
        (5, "data_table", "", "", ["a"], "", None),
    ]
    got = {(r.k, r.metric_id, r.col_idx): (r.unit, r.amount, r.segment, r["product"], r.confidence) for r in m.extract_metrics(spark.createDataFrame(rows, COLUMNS)).collect()}
    assert got == {
        (1, "revenue", 0): ("KRW", 10e6, "반도체", "DRAM", 0.95),
        (1, "revenue", 2): ("KRW", 8e6, "반도체", "DRAM", 0.95),
        (2, "revenue", 0): ("inferred_KRW", 10.0, "소계", "소계", 0.455),
        (3, "quantity_sold", 0): ("MWh", 2000.0, "", "company", 0.95),
        (3, "utilization_rate", 1): ("percent", 90.0, "", "company", 0.8075),
    }
