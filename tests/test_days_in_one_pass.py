"""Families of factors share one frame of days: as-of tables join it in one pass, and no family is joined back by day."""

import datetime as dt
import os

import pytest

from pitmill.operators.asof import asof_join, asof_joins
from pitmill.operators.periods import wide_statements
from pitmill.queries import QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
D = dt.date


def test_several_tables_join_as_each_by_itself(spark):
    left = spark.createDataFrame([("a", D(2024, 1, k), k) for k in (1, 5, 9)] + [("b", D(2024, 1, 5), 7)], "security_id string, trade_date date, k int")
    one = spark.createDataFrame([("a", D(2024, 1, 5), 1.0), ("a", D(2024, 1, 5), 3.0), ("a", D(2024, 1, 7), None), ("b", None, 9.0)], "security_id string, known date, v double")
    two = spark.createDataFrame([("b", D(2024, 1, 2), "x"), ("a", D(2024, 1, 9), "y")], "security_id string, seen date, w string")
    want = asof_join(asof_join(left, one, ["security_id"], "trade_date", "known"), two, ["security_id"], "trade_date", "seen")
    got = asof_joins(left, ["security_id"], "trade_date", [(one, "known"), (two, "seen")])
    assert sorted(map(str, got.select(sorted(got.columns)).collect())) == sorted(map(str, want.select(sorted(want.columns)).collect()))


def test_the_amount_of_largest_size_counts(spark):
    rows = [("a", 2020, 3, "NI", x, D(2020, 5, k)) for k, x in ((1, 2.0), (2, -5.0), (3, 5.0), (4, None))] + [("a", 2020, 6, "NI", -3.0, D(2020, 8, 1)), ("a", 2020, 6, "NI", 1.0, D(2020, 8, 9))]
    got = wide_statements(spark.createDataFrame(rows, "security_id string, fiscal_year int, fiscal_month int, canonical_id string, amount double, report_date date"), ["NI", "TA"])
    assert sorted((r.fiscal_month, r.NI, r.TA, r.report_date) for r in got.collect()) == [(3, 5.0, None, D(2020, 5, 3)), (6, -3.0, None, D(2020, 8, 9))]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
def test_no_family_is_joined_back_by_day(spark):
    plan = QUERIES["daily_factor_rows"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join " in line and "trade_date" in line and "market" not in line]
    assert joins == [] and plan.count("Union") <= 2
