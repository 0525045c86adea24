from pyspark.sql import functions as F

from pitmill.queries.daily_rows import factor_rows
from pitmill.sources import views


def test_families_neither_add_nor_drop_days(spark):
    days = spark.createDataFrame([("A", 1), ("A", 2), ("B", 1)], "security_id string, trade_date int")
    one = spark.createDataFrame([("A", 2, 5.0), ("C", 1, 7.0)], "security_id string, trade_date int, x double")
    two = spark.createDataFrame([("B", 1, "f", 1)], "security_id string, trade_date int, flag string, other int")
    got = sorted(tuple(r) for r in factor_rows(days, [(one, {"x": "a"}), (two, {"flag": "flag"})]).collect())
    assert got == [("A", 1, None, None), ("A", 2, 5.0, None), ("B", 1, None, "f")]


def test_a_view_that_is_written_is_read_and_not_made_again(spark, tmp_path):
    lines = spark.createDataFrame([(1, "2020-01-02", 10.0, 200.0), (1, "2020-01-02", 5.0, 150.0)], "l_suppkey long, l_shipdate string, l_quantity double, l_extendedprice double")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    folder = views.materialised(spark, str(tmp_path), views.price_daily)
    assert folder == str(tmp_path) and views.read(spark, folder, "lineitem").count() == 2
    want, got = views.price_daily(spark, str(tmp_path)), views.price_daily(spark, folder)
    assert got.collect() == want.collect() and got.schema == want.schema
    assert "l_extendedprice" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert got.select(F.col("close")).first().close == 23.33
