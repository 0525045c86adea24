"""A plan of many families deals lines out by security once; days, quarters and weeks are made where they are."""

import datetime as dt
import os

import pytest

from pitmill.queries import QUERIES
from pitmill.sources import views

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_dealt_lines_give_the_same_days_and_quarters(spark, tmp_path):
    day = dt.datetime(2020, 2, 3)
    flags = [(r, s) for r in ("R", "A", "N", "RX", None) for s in ("O", "F", None)]
    rows = [(k % 2 + 1, day if k < 9 else None if k == 9 else day + dt.timedelta(60), 2.0 + k, None if k == 4 else 100.0 + k, 0.09, 0.02, r, s) for k, (r, s) in enumerate(flags)]
    spark.createDataFrame(rows, "l_suppkey long, l_shipdate timestamp, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string").write.parquet(f"{tmp_path}/lineitem.parquet")
    for view in (views.price_daily, views.quarters):
        want, got = view(spark, str(tmp_path)), view(spark, views.dealt(spark, str(tmp_path)))
        assert got.schema.simpleString() == want.schema.simpleString() and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")
@pytest.mark.parametrize("name", ["daily_factor_rows", "wacc"])
def test_what_is_made_of_lines_has_no_shuffle_of_its_own(spark, name):
    df = QUERIES[name](spark, DATA)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].splitlines()
    exchanges = [x for x in plan if "Exchange hashpartitioning(security_id" in x and "Reused" not in x]
    assert sum("FileScan" in x and "l_tax" in x for x in plan) == 1
    assert len(exchanges) <= 3  # lines, reports, and the master to its days
    assert not any("price_daily-" in x for x in plan)
