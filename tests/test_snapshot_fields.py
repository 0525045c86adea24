"""A snapshot of several values from which a query reads some only."""

import datetime as dt

from pyspark.sql import functions as F

from pitmill.operators.asof import snapshot

D = dt.date


def test_any_of_the_values_can_be_read_alone_or_together(spark):
    facts = spark.createDataFrame([("a", D(2024, 1, 2), 1.0, 2.0), ("a", D(2024, 1, 9), 3.0, 4.0), ("b", D(2024, 2, 1), 5.0, 6.0)], "security_id string, trade_date date, r double, v double")
    dates = spark.createDataFrame([(D(2024, 1, 31),), (D(2024, 2, 29),)], "trade_date date")
    got = snapshot(facts, dates, ["security_id"])
    assert sorted((r.trade_date, r.n, r.r, r.v) for r in got.groupBy("trade_date").agg(F.count("*").alias("n"), F.sum("r").alias("r"), F.sum("v").alias("v")).collect()) == [(D(2024, 1, 31), 1, 3.0, 4.0), (D(2024, 2, 29), 2, 8.0, 10.0)]
    assert sorted((r.security_id, r.v) for r in got.select("security_id", "v").collect()) == [("a", 4.0), ("a", 4.0), ("b", 6.0)]
    assert {r.source_trade_date for r in got.select("source_trade_date").collect()} == {D(2024, 1, 9), D(2024, 2, 1)}
