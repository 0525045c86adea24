"""Steps of the factor lab that are made once: snapshots, multiples, positions, and what the last day alone tells."""

import datetime as dt
import os

import pytest

from pitmill.operators.asof import snapshot
from pitmill.plans import lab as lab_plans
from pitmill.plans import valuation
from pitmill.queries import QUERIES, deepen, graphs, lab

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
D = dt.date
tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")


def plan_of(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


@tables
def test_a_run_and_the_graph_over_it_share_one_table_of_snapshots(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graphs, "write_factors", lambda rows, path, write=graphs.write_factors: (written.append(path), write(rows, path)))
    lab.lab_factor(spark, DATA)
    assert len(written) == 1


def test_valuation_keeps_a_row_a_month(spark):
    days = [("a", "per", "annual", D(2024, 1, k), float(k), "x") for k in range(1, 32)] + [("a", "per", "annual", D(2024, 2, 1), 50.0, "x")]
    rows = spark.createDataFrame(days, "security_id string, factor_id string, basis string, trade_date date, multiple double, g string")
    assert sorted((r.trade_date, r._newest) for r in valuation._marked(rows, None).collect()) == [(D(2024, 1, 31), False), (D(2024, 2, 1), True)]


@tables
def test_valuation_does_not_write_every_day(spark, monkeypatch):
    monkeypatch.setattr(lab, "write_factors", None)
    assert lab.valuation_levels(spark, DATA).columns[:2] == ["security_id", "factor_id"]


@tables
def test_scores_of_the_market_need_no_groups(spark):
    assert "Join" not in plan_of(QUERIES["graph_dense_score"](spark, DATA))


def test_changes_read_positions_once(spark):
    calendar = spark.createDataFrame([(k, D(2024, k, 1)) for k in (1, 2, 3)], "segment_id int, signal_date date")
    positions = spark.createDataFrame([(D(2024, 1, 1), "a"), (D(2024, 1, 1), "b"), (D(2024, 2, 1), "a"), (D(2024, 3, 1), "c")], "signal_date date, security_id string")
    out = lab_plans.entered_and_left(positions, calendar)
    assert "FullOuter" not in plan_of(out)
    assert sorted(map(tuple, out.collect())) == [(1, "a", "entered"), (1, "b", "entered"), (2, "b", "left"), (3, "a", "left"), (3, "c", "entered")]


@tables
def test_the_daily_build_neither_joins_nor_repeats_days(spark):
    plan = plan_of(QUERIES["daily_factor_build"](spark, DATA))
    assert "Join" not in plan and "Expand" not in plan


@tables
def test_latest_values_come_from_the_last_day(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(deepen, "_valued", lambda *a, made=deepen._valued, **k: (asked.append(k), made(*a, **k))[1])
    deepen.industry_winsorized(spark, DATA)
    assert asked == [{"last_only": True}]


def test_a_snapshot_joins_no_spine(spark):
    facts = spark.createDataFrame([("a", D(2023, 1, 2), 1.0), ("a", D(2024, 1, 8), None), ("a", D(2024, 1, 8), 2.0), ("b", D(2024, 3, 9), 3.0), ("c", None, 4.0), (None, D(2024, 1, 5), 5.0)], "k string, day date, v double")
    dates = spark.createDataFrame([(D(2024, 1, 5),), (D(2024, 1, 9),), (D(2024, 3, 8),), (None,)], "day date")
    out = snapshot(facts, dates, ["k"], "day")
    rows = sorted((str(r.k), r.day, r.source_trade_date, r.v) for r in out.collect())
    assert rows == [("None", D(2024, 1, 5), D(2024, 1, 5), 5.0), ("None", D(2024, 1, 9), D(2024, 1, 5), 5.0), ("None", D(2024, 3, 8), D(2024, 1, 5), 5.0), ("a", D(2024, 1, 5), D(2023, 1, 2), 1.0), ("a", D(2024, 1, 9), D(2024, 1, 8), 2.0), ("a", D(2024, 3, 8), D(2024, 1, 8), 2.0)]
    assert "Union" not in plan_of(out) and out.columns == ["k", "day", "source_trade_date", "v"]
    assert sorted(r.day for r in snapshot(facts, dates, ["k"], "day", max_age=1).collect()) == [D(2024, 1, 5), D(2024, 1, 9)]
    assert snapshot(facts, dates.where("day IS NULL"), ["k"], "day").collect() == []
