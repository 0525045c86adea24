"""Window factors against plain loops."""

import math
import random

import numpy as np

from pitmill.functions import technical as t
from pitmill.functions.sliding import with_sliding_percentiles
from pitmill.plans import lab


def panel(spark, n_days=(1, 5, 40, 173), seed=2):
    rng = random.Random(seed)
    rows = []
    for s, days in enumerate(n_days):
        for k in range(days):
            r = None if rng.random() < 0.1 else -1.0 if s == 3 and k == 60 else round(rng.gauss(0, 0.05), 4)
            rows.append((s, k, r))
    return rows, spark.createDataFrame(rows, "security_id int, trade_date int, ret double").repartition(3)


def fall(returns):
    wealth = peak = 1.0
    worst = 0.0
    for r in returns:
        wealth *= 1 + r
        peak = max(peak, wealth)
        worst = min(worst, wealth / peak - 1)
    return worst * 100


def test_drawdown_equals_the_fold_over_each_window(spark):
    rows, df = panel(spark)
    by = {}
    for s, k, r in rows:
        by.setdefault(s, []).append(r)
    for skip, n, least in ((0, 7, 1), (3, 10, 4), (5, 1, 1), (2, 50, 3)):
        got = {(r.security_id, r.trade_date): r.max_drawdown for r in t.with_max_drawdown(df, skip=skip, n=n, least=least).collect()}
        assert len(got) == len(rows)
        for (s, k), value in got.items():
            held = [r for r in by[s][max(0, k - skip - n + 1) : max(0, k - skip + 1)] if r is not None]
            want = fall(held) if len(held) >= least else None
            assert (value is None) == (want is None) and (want is None or math.isclose(value, want, rel_tol=1e-9, abs_tol=1e-9)), (s, k, skip, n, value, want)


def test_drawdown_of_nothing(spark):
    empty = spark.createDataFrame([], "security_id int, trade_date int, ret double")
    assert t.with_max_drawdown(empty).collect() == []


def test_sliding_percentile_equals_counting(spark):
    rng = random.Random(9)
    rows = [(s, k, None if rng.random() < 0.1 else float(rng.randrange(8)), rng.gauss(0, 1)) for s in "ab" for k in range(200)]
    df = spark.createDataFrame(rows, "s string, k int, v double, w double").repartition(3)
    n, least = 25, 5
    got = {(r.s, r.k): (r.p, r.q) for r in with_sliding_percentiles(df, "s", "k", {"p": ("v", False), "q": ("w", True)}, n, least).collect()}
    for s, k, v, w in rows:
        held = [(x, y) for a, i, x, y in rows if a == s and k - n < i <= k]
        xs = [x for x, _ in held if x is not None]
        want = None if v is None or len(xs) < least else (sum(x < v for x in xs) + (sum(x == v for x in xs) + 1) / 2) / len(xs) * 100
        low = None if len(held) < least else (sum(y > w for _, y in held) + 1) / len(held) * 100
        assert got[s, k] == (want, low)
    one = with_sliding_percentiles(df.where("s = 'a'"), None, "k", {"p": ("v", False)}, n, least)
    assert {r.k: r.p for r in one.collect()} == {k: p for (s, k), (p, _) in got.items() if s == "a"}


def test_matrix_products_choose_what_sorting_chooses(spark):
    rng = random.Random(5)
    day = lambda d: f"2020-01-{d + 1:02d}"
    rows = [(day(d), f"S{s:02d}", float(rng.randrange(4)), float(rng.randrange(3)), None if rng.random() < 0.1 else rng.gauss(0, 1)) for d in range(9) for s in range(3 * d + 1)]
    panel = spark.createDataFrame(rows, "d string, security_id string, a double, b double, forward double").selectExpr("CAST(d AS DATE) AS trade_date", "security_id", "a", "b", "forward").repartition(4)
    vectors = [(v, v / 40, 1 - v / 40, 1 + v % 4) for v in range(41)]
    frame = spark.createDataFrame(vectors, "vector long, w_a double, w_b double, positions int")
    got = {(r.vector, str(r.trade_date)): (r.n, r.total) for r in lab.daily_best(panel, frame, ["a", "b"], None).collect()}
    assert len(got) == 41 * 9
    for v, wa, wb, k in vectors:
        for d in {r[0] for r in rows}:
            best = sorted((r for r in rows if r[0] == d), key=lambda r: (-round(wa * r[2] + wb * r[3], 9), r[1]))[:k]
            known = [r[4] for r in best if r[4] is not None]
            assert got[v, d][0] == len(known) and math.isclose(got[v, d][1], sum(known), abs_tol=1e-9)
    scores = np.array([[1.0, 5.0], [3.0, 5.0], [3.0, 1.0]])
    assert lab.best_of_day(scores, np.array([1, 2])).tolist() == [[False, True], [True, True], [False, False]]
