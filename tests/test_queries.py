"""Registered queries of the factor library against their SQL, on the small driver tables."""

import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")
from pitmill.queries import QUERIES, SQL  # noqa: E402

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: A few of each module by default; all of them with TEST_ALL_QUERIES=1.
SOME = """price_daily_from_lines factor_melt_long momentum rsi rolling_beta annual_margins piotroski valuation_multiples dividend_streaks unit_scale_repair
snapshot_incremental style_scores screen_mixed_all bands_market graph_nested graph_shrunk_zscore graph_weighted_renormalized nav_curve eval_ic
target_consensus_boundaries composite_provider sector_classify formula_checks stream_latest_version factor_catalog stream_snapshot
stream_late_filings dividend_scan risk_free_rates metric_flags asof_stale_forward strict_targets validity_marks screen_filtered lab_factor run_ranking
rebalance_semiannual vectors_train_test central_band sign_policy reports_json industry_winsorized beneish rolling_mdd accounts_by_context
valuation_levels country_risk_scores stream_expired_estimates stream_closed_windows metric_cells graph_at_dates candidates_screened wacc""".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no driver tables here")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return str(v) if hasattr(v, "isoformat") else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES) if os.environ.get("TEST_ALL_QUERIES") else SOME)
def test_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    cursor = duck.execute(SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    order = sorted(columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=key)
    want = sorted((tuple(plain(dict(zip(columns, r))[c]) for c in order) for r in cursor.fetchall()), key=key)
    assert got == want


def test_every_query_has_sql():
    assert QUERIES.keys() == SQL.keys()
