import json

from pitmill.sources import provider_payloads as pp


def test_arrays_slots_and_bad_payloads(spark):
    data = {
        "earnings_estimate": [{"period": "0q", "avg": 1.0, "low": 0.5, "high": 2.0, "numberOfAnalysts": 4}, {"period": "0q", "low": 99.0}, {"period": "5y", "low": 1.0}],
        "eps_trend": [{"period": "0y", "current": 3.0, "30daysAgo": 2.5}],
        "earnings_history": [{"date": "2020-01-02", "epsActual": 1.2, "epsEstimate": 1.0, "surprisePercent": 0.2}, {"date": "2020-04-02", "surprisePercent": -12.0}, {"epsActual": 1.0}],
    }
    rows = [json.dumps({"symbol": "A", "snapshot": "2020-05-01", "data": data}), '{"symbol": "B", "data"', json.dumps({"snapshot": "2020-05-01", "data": data}), json.dumps({"symbol": "C"}), None]
    parsed = pp.parsed(spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, payload string"))
    assert sorted(r.i for r in parsed.where("is_bad").collect()) == [1, 2, 4]
    got = {(r.horizon, r.metric, r.statistic, r.lookback): (r.value, r.analysts) for r in pp.observations(parsed).collect()}
    assert got == {("FQ1", "eps", "low", 0): (0.5, 4), ("FQ1", "eps", "high", 0): (2.0, 4), ("FY1", "eps", "average", 0): (3.0, None), ("FY1", "eps", "average", 30): (2.5, None)}
    events = sorted((str(r.event_date), r.surprise_pct, r.reported_eps) for r in pp.releases(parsed).collect())
    assert events == [("2020-01-02", 20.0, 1.2), ("2020-04-02", -12.0, None)]
