"""A payload is parsed once, whatever is asked of it; one that does not parse is counted in the same pass."""

from pyspark.sql import functions as F

from pitmill.queries import provider_feeds
from pitmill.sources import provider_payloads as pp

LINES = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_shipdate timestamp"


def lines(spark, path, keys):
    rows = spark.createDataFrame([(k, 1, 1, n, 10.0 * n, 100.0, 0.05, 0.02) for k in keys for n in (1, 2, 5)], LINES.removesuffix(", l_shipdate timestamp"))
    rows.withColumn("l_shipdate", F.expr("timestamp'2020-01-02'")).write.parquet(f"{path}/lineitem.parquet")
    return provider_feeds.provider_arrays(spark, str(path))


def test_one_parse_and_one_scan(spark, tmp_path):
    out = lines(spark, tmp_path, [1, 40, 80])
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1 and plan.count("Relation [") == 1
    got = {(r.symbol, r.horizon, r.metric, r.statistic, r.lookback): (r.n, r.total, r.analysts) for r in out.collect()}
    assert got[None, None, "unparsed", None, None] == (2, None, None)
    assert got["S1", "FQ1", "eps", "high", 0] == (1, 20.0, 1) and got["S1", "FQ2", "eps", "average", 7] == (1, 27.0, 2) and len(got) == 1 + 2 * 11


def test_none_unparsed_is_told(spark, tmp_path):
    assert [r.n for r in lines(spark, tmp_path, [1]).where("metric = 'unparsed'").collect()] == [0]


def test_texts_that_do_not_parse_give_nothing_else(spark):
    texts = ['{"symbol": "A", "data": {"eps_trend": [{"period": "0q", "current": 1.5}]}}', '{"symbol": "B", "data": {"eps', '{"data": {}}', '{"symbol": "C"}']
    rows = pp.parsed(spark.createDataFrame([(t,) for t in texts], "payload string"))
    assert [(r.symbol, r.metric, r.value, r.analysts) for r in pp.observations(rows).collect()] == [("A", "eps", 1.5, None)]
    assert sorted((str(r.symbol), r.metric) for r in pp.observations(rows, unparsed=True).collect()) == [("A", "eps"), ("None", "unparsed"), ("None", "unparsed")]
