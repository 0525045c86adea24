"""The cells of a table are parsed once, and rules look for words without regular expressions."""

import json

from pitmill.operators import metric_tables as m


def test_one_parse_and_no_alternatives(spark):
    cells = json.dumps({"판매량 > 당기": "1,000", "제23기 매출액": "7", "매출\t액": "△ 2"}, ensure_ascii=False)
    rows = spark.createDataFrame([(1, "data_table", "백만원", "", ["합 계", "x"], "", cells), (2, "data_table", "", "생산량", None, "a | b", "{}")], "k int, table_kind string, unit_text string, caption string, row_values array<string>, row_text string, header_values string")
    out = m.extract_metrics(rows)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") <= 1 and plan.count("RLIKE(") <= 1
    assert sorted((r.metric_id, r.amount, r.segment, r["product"]) for r in out.collect()) == [("quantity_sold", 1000.0, "합 계", "합 계"), ("revenue", -2e6, "합 계", "합 계")]
    assert out.columns == ["k", "table_kind", "unit_text", "caption", "row_values", "row_text", "col_idx", "raw_label", "raw_value", "metric_id", "unit", "amount", "segment", "product", "confidence"]
