import re
from datetime import date

import pytest

from pitmill.plans import graph as g
from pitmill.queries.graphs import LOOKS_BACK, one, two
from pitmill.sources.tables import read_factors, shared_path, write_factors

DAYS = [date(2020, m, 28) for m in range(1, 13)]


@pytest.fixture(scope="module")
def context(spark):
    path = shared_path(spark, "factors")
    rows = [(d, f"S{s}", f, float((s + 2) * (k + 1) ** 2 % 17 + (f == "high_gap"))) for k, d in enumerate(DAYS) for s in range(6) for f in ("mom_1m", "high_gap") if not (s == 1 and k % 3 == 0)]
    write_factors(spark.createDataFrame(rows, "trade_date date, security_id string, factor_id string, factor_value double"), path)
    factors = read_factors(spark, path)
    base = factors.selectExpr("month", "trade_date", "security_id", "security_id > 'S2' AS sector", "security_id AS industry_group").distinct()
    return g.Context(factors, base)


def rows(frame):
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("dates", [[DAYS[-1]], [DAYS[4], DAYS[9]], DAYS[:2]])
def test_dates_give_what_the_whole_run_gives(context, dates):
    for graph in (LOOKS_BACK, one("lag", {"periods": 2}), one("rolling_max", {"op": "max", "window": 3}), two("add"), one("rank", {"op": "rank"})):
        assert rows(g.run_dates(graph, context, dates)) == rows(g.at_dates(g.run(graph, context), dates))


def partition_filters(frame):
    """What each scan of the plan asks of the months."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return [re.sub(r"#\d+", "", x) for x in re.findall(r"PartitionFilters: \[(.*?)\]", plan)]


def test_only_what_looks_back_reads_the_past(context):
    plain = partition_filters(g.run_dates(two("add"), context, [DAYS[7]]))
    assert plain and all(re.search(r"month (=|IN) \(?2020-08", f) for f in plain)
    back = partition_filters(g.run_dates(one("lag", {"periods": 2}), context, [DAYS[7]]))
    assert back and all("month <= 2020-08" in f for f in back)
    frames = g.build_dates(LOOKS_BACK, context, [DAYS[7]])
    assert g.needs_history(LOOKS_BACK) == {"a", "b"} and all(re.search(r"month (=|IN) \(?2020-08", f) for f in partition_filters(frames["z"])[2:])
    assert g.row_limits(LOOKS_BACK, [DAYS[7]]) == {"a": 4} and g.row_limits(LOOKS_BACK, DAYS[:2]) == {}


def test_strict_runs_fail_where_a_snapshot_is_missing(context):
    gap = g.Context(context.factors.where(~((context.factors.factor_id == "mom_1m") & (context.factors.trade_date == DAYS[3]))), context.base)
    assert rows(g.run_dates(two("add"), gap, [DAYS[2]], strict=True))
    with pytest.raises(ValueError, match="2020-04-28"):
        g.run_dates(two("add"), gap, DAYS[2:5], strict=True)
    with pytest.raises(ValueError, match="lab"):
        g.require_coverage(one("log") | {"nodes": [{"id": "a", "type": "factor_input", "config": {"factor_id": "lab_x"}}]}, context.factors, DAYS)
