"""Operators on small hand-made frames, with their edge rows."""

import datetime as dt
import math

import pandas as pd
import pytest
from pyspark.sql import functions as F

from pitmill.functions import semantics as s
from pitmill.functions import technical as t
from pitmill.functions.cross_section import quantile_exact
from pitmill.operators.asof import asof_join, carry_forward, latest_version, snapshot
from pitmill.operators.periods import repair_scale, single_quarters, trailing
from pitmill.plans import graph as g
from pitmill.sources import readers
from pitmill.sources.tables import read_factors, shared_path, write_factors
from pitmill.streaming.incremental import keep_latest, late_safe_counts

D = dt.date


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_scalar_rules(spark):
    assert one(spark, s.divide(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, s.finite(F.lit(float("nan")))) is None and one(spark, s.finite(F.lit(float("-inf")))) is None
    assert one(spark, s.growth_percent(F.lit(-5.0), F.lit(-10.0))) == 50
    assert one(spark, s.profit_growth_percent(F.lit(5.0), F.lit(-10.0))) is None
    assert one(spark, s.bounded(F.lit(30.0), F.lit(10.0), 2)) is None and one(spark, s.bounded(F.lit(30.0), F.lit(None).cast("double"), 2)) == 30
    assert one(spark, s.amount_text(F.lit("(1,234)"))) == -1234 and one(spark, s.amount_text(F.lit("△ 5"))) == -5 and one(spark, s.amount_text(F.lit("-"))) is None
    assert one(spark, s.unit_factor(F.lit("단위: 백만원"))) == 1e6
    assert one(spark, s.period_text_end(F.lit("2024.02"))) == D(2024, 2, 29) and one(spark, s.period_text_end(F.lit("2024.13"))) is None
    assert one(spark, s.security_id("KR", F.lit("5930"))) == "SEC_KR_005930"
    assert one(spark, s.account_name(F.lit("IV. Net Sales (note 3)"))) == "netsales"


def test_year_to_date_to_quarters_and_trailing(spark):
    rows = [("a", 2025, m, v) for m, v in ((3, 10.0), (6, 25.0), (9, 45.0), (12, 80.0))] + [("a", 2026, 3, None)]
    df = spark.createDataFrame(rows, "security_id string, fiscal_year int, fiscal_month int, NI double")
    q = single_quarters(df, ["NI"])
    assert [r.NI for r in q.orderBy("fiscal_year", "fiscal_month").collect()] == [10, 15, 20, 35, None]
    assert [r.NI for r in trailing(q, ["NI"]).orderBy("fiscal_year", "fiscal_month").collect()] == [None, None, None, 80, None]


def frames(spark):
    left = spark.createDataFrame([("a", D(2024, 1, k), k) for k in (1, 5, 9)] + [("b", D(2024, 1, 5), 0)], "security_id string, trade_date date, k int")
    right = spark.createDataFrame([("a", D(2024, 1, 5), 1.0), ("a", D(2024, 1, 7), None), ("a", D(2024, 1, 20), 9.0)], "security_id string, known date, v double")
    return left, right


@pytest.mark.parametrize(("options", "want"), [({}, [None, 1.0, None]), ({"strict": True}, [None, None, None]), ({"each": True}, [None, 1.0, 1.0]), ({"max_age": 0}, [None, 1.0, None])])
def test_asof(spark, options, want):
    left, right = frames(spark)
    got = asof_join(left, right, ["security_id"], "trade_date", "known", **options).where("security_id = 'a'").orderBy("trade_date").collect()
    assert [r.v for r in got] == want and [r.k for r in got] == [1, 5, 9]


def test_later_rows_never_change_a_snapshot(spark):
    facts = spark.createDataFrame([("a", "f", D(2024, 1, 2), 1.0), ("a", "f", D(2024, 1, 8), 2.0), ("b", "f", D(2024, 1, 9), 3.0)], "security_id string, factor_id string, trade_date date, factor_value double")
    dates = spark.createDataFrame([(D(2024, 1, 5),), (D(2024, 1, 9),)], "trade_date date")
    base = sorted(map(tuple, snapshot(facts, dates, ["security_id", "factor_id"]).select("trade_date", "security_id", "factor_value").collect()))
    assert base == [(D(2024, 1, 5), "a", 1.0), (D(2024, 1, 9), "a", 2.0), (D(2024, 1, 9), "b", 3.0)]
    more = facts.union(spark.createDataFrame([("a", "f", D(2024, 2, 1), 99.0)], facts.schema))
    assert sorted(map(tuple, snapshot(more, dates, ["security_id", "factor_id"]).select("trade_date", "security_id", "factor_value").collect())) == base


def test_versions_and_carry_forward(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 2.0), ("b", 1, 3.0)], "k string, version int, v double")
    assert sorted((r.k, r.v) for r in latest_version(df, ["k"], "version").collect()) == [("a", 2.0), ("b", 3.0)]
    today = df.where("k = 'b'")
    assert sorted((r.k, r.version) for r in carry_forward(today, df, ["k"]).collect()) == [("a", 1), ("a", 2), ("b", 1)]


def test_exact_quantile_has_no_interpolation(spark):
    df = spark.createDataFrame([("x", float(v)) for v in (1, 2, 3, 4)] + [("x", None), ("y", 7.0)], "g string, v double")
    assert {r.g: (r.a, r.b) for r in quantile_exact(df, ["g"], "v", {"a": 0.5, "b": 1.0}).collect()} == {"x": (3.0, 4.0), "y": (7.0, 7.0)}


def test_technical_against_pandas(spark):
    close = [100 + 10 * math.sin(k / 5) + k * 0.1 for k in range(120)]
    p = spark.createDataFrame([("a", D(2024, 1, 1) + dt.timedelta(k), c, c + 1, c - 1, 10.0) for k, c in enumerate(close)], "security_id string, trade_date date, close double, high double, low double, volume double")
    x = pd.Series(close)
    got = p.select("trade_date", t.moving_average(F.col("close"), 20).alias("ma"), t.williams_r(F.col("high"), F.col("low"), F.col("close")).alias("wr")).orderBy("trade_date").toPandas()
    assert got.ma.sub(x.rolling(20).mean()).abs().max() < 1e-9
    want = (x + 1).rolling(14).max().sub(x).div((x + 1).rolling(14).max() - (x - 1).rolling(14).min()) * -100
    assert got.wr.sub(want).abs().max() < 1e-9
    ewm = t.smoothed(p, "close", {"e": (0.2, 5)}).orderBy("trade_date").toPandas().e
    assert ewm.isna().sum() == 4 and ewm.sub(x.ewm(alpha=0.2, adjust=False, min_periods=5).mean()).abs().max() < 1e-9


def test_scale_repair(spark):
    rows = [("s", 2020 + k, 12, a, 100.0 * (1000 if k == 1 else 1)) for k in range(3) for a in "abcd"]
    got = repair_scale(spark.createDataFrame(rows, "security_id string, fiscal_year int, fiscal_month int, canonical_id string, amount double"))
    assert {r.amount for r in got.collect()} == {100.0} and got.where("scaled_by = 1000").count() == 4


def context(spark):
    rows = [(D(2024, 1, 1), x, f, v) for x, a, b in (("a", 1.0, 2.0), ("b", 4.0, 0.0), ("c", None, 1.0)) for f, v in (("p", a), ("q", b))]
    base = spark.createDataFrame([(D(2024, 1, 1), x, "i", "s") for x in "abc"], "trade_date date, security_id string, industry_group string, sector string")
    return g.Context(spark.createDataFrame(rows, "trade_date date, security_id string, factor_id string, factor_value double"), base)


def test_graph_reasons_and_cycles(spark):
    nodes = [{"id": "p", "type": "factor_input", "config": {"factor_id": "p"}}, {"id": "q", "type": "factor_input", "config": {"factor_id": "q"}}, {"id": "d", "type": "divide"}]
    edges = [{"source": "p", "target": "d", "target_handle": "a"}, {"source": "q", "target": "d", "target_handle": "b"}]
    got = {r.security_id: (r.value, r.invalid_reason) for r in g.run({"nodes": nodes, "edges": edges, "outputs": {"final_node_id": "d"}}, context(spark)).collect()}
    assert got == {"a": (0.5, None), "b": (None, "division_by_zero"), "c": (None, "source_null")}
    with pytest.raises(ValueError, match="cycle"):
        g.topological({"nodes": nodes, "edges": [*edges, {"source": "d", "target": "p"}]})


def test_price_files(spark):
    raw = spark.createDataFrame([("AA", "2024-01-02", "10", "9.5", "1"), ("AA", "2024-01-02", "11", "9.5", "2"), ("AA", "bad", "1", "1", "3"), ("AA", "2024-01-03", "NaN", "1", "3")], "symbol string, Date string, Close string, `Adj Close` string, updated_at string")
    got = readers.normalize_prices(raw, "US").collect()
    assert [(r.security_id, r.trade_date, r.close, r.adj_close) for r in got] == [("SEC_US_AA", D(2024, 1, 2), 11.0, 9.5)]


def test_reports_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"report_id": "1", "symbol": "5930", "register_date": "2024-01-05", "target_price": "1,000", "period_1": "2024.12", "eps_1": "10", "period_2": "x", "eps_2": "3"}\nnot json\n')
    reports, estimates, bad = readers.read_reports(spark, str(tmp_path / "a.json"))
    assert reports.first().target_price == 1000 and [(r.target_period, r.estimate_value) for r in estimates.collect()] == [("2024.12", 10.0)] and bad.count() == 1


def test_factor_table_by_month(spark):
    path = shared_path(spark, "factors")
    rows = spark.createDataFrame([(D(2024, m, 1), "a", "f", float(m)) for m in (1, 2)], "trade_date date, security_id string, factor_id string, factor_value double")
    write_factors(rows, path)
    write_factors(rows.where("factor_value = 2").withColumn("factor_value", F.lit(5.0)), path)
    assert sorted(r.factor_value for r in read_factors(spark, path, ["f"]).collect()) == [1.0, 5.0]
    assert [r.factor_value for r in read_factors(spark, path, first="2024-02-01").collect()] == [5.0]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(k % 3, k, float(k)) for k in range(20)]
    df = spark.createDataFrame(rows, "key int, version int, v double")
    for k in range(4):
        df.where(F.col("version") % 4 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted(map(tuple, keep_latest(stream, ["key"], ["version"]).collect()))
    assert got == sorted(map(tuple, latest_version(df, ["key"], "version").collect()))
    assert late_safe_counts(stream.withColumn("ts", F.current_timestamp()).withColumn("value", F.col("v")), "ts", ["key"]).isStreaming
