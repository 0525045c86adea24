import statistics
from datetime import date

from pitmill.plans.valuation import basis_order, level_statistics, valuation

LEVELS = {"venue": "venue", "industry": "industry", "market": "market"}
SCHEMA = "security_id string, factor_id string, basis string, trade_date date, multiple double, venue string, industry string, market string"


def frame(spark, *rows):
    return spark.createDataFrame([(s, f, b, d, m, {"A": "MAIN", "B": "MAIN"}.get(s), "I" if s < "C" else "J", "ALL") for s, f, b, d, m in rows], SCHEMA)


def test_levels_history_and_fallback(spark):
    days = [date(2020, 1, 10), date(2020, 1, 31), date(2020, 2, 28), date(2020, 3, 2)]
    rows = [("A", "per", "annual", d, m) for d, m in zip(days, (5.0, 10.0, 20.0, 30.0))]
    rows += [("B", "per", "ttm", days[2], 7.0), ("C", "per", "quarterly", days[1], 9.0), ("C", "per", "odd", days[3], 99.0), ("B", "pbr", "ttm", days[0], 2.0), ("B", "pbr", "annual", days[0], None)]
    got = {(r.security_id, r.factor_id): r for r in valuation(frame(spark, *rows), LEVELS).collect()}
    a, b, c, p = got["A", "per"], got["B", "per"], got["C", "per"], got["B", "pbr"]
    assert len(got) == 4 and (a.multiple, a.basis, b.basis, c.basis, c.multiple, p.basis) == (30.0, "annual", "ttm", "quarterly", 9.0, "ttm")
    assert (a.own_n, a.own_p50) == (3, statistics.median([10.0, 20.0, 30.0]))
    assert b.own_n is None and c.own_n is None  # the history is annual or nothing
    assert (a.venue_n, a.venue_basis, a.venue_p50) == (1, "annual", 30.0) == (b.venue_n, b.venue_basis, b.venue_p50)
    assert c.venue_n is None and (c.industry_basis, c.industry_p50, c.market_p50) == ("quarterly", 9.0, 30.0)
    assert (p.industry_basis, p.industry_p50) == ("ttm", 2.0)
    early = {(r.security_id, r.factor_id): r for r in valuation(frame(spark, *rows), LEVELS, wanted="ttm", as_of=date(2020, 2, 1)).collect()}
    assert early["A", "per"].multiple == 10.0 and ("B", "per") not in early and early["A", "per"].market_basis == "annual"


def test_one_aggregation_and_nothing_from_nothing(spark):
    assert basis_order("quarterly") == ["quarterly", "annual", "ttm"]
    empty = frame(spark, ("A", "per", "annual", date(2020, 1, 1), None))
    assert valuation(empty, LEVELS).collect() == [] and level_statistics(empty, LEVELS).collect() == []
