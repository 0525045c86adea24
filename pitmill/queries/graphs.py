"""One query a node type, and graphs of several nodes, over month-end snapshots."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..plans import graph as g
from ..sources.tables import read_factors, shared_path, write_factors
from ..sources.views import security_master, sql
from .scoring import FACTORS, snapshots


def context(spark, d):
    """Month-end snapshots, kept as the table by month that runs read: nodes scan it, not what it was made of."""
    path = shared_path(spark, "snapshots")
    write_factors(snapshots(spark, d).select("trade_date", "security_id", "factor_id", "factor_value"), path)
    rows = read_factors(spark, path)
    master = security_master(spark, d).select("security_id", "industry_group", "sector")
    base = rows.select("month", "trade_date", "security_id").distinct().join(master, "security_id")
    return g.Context(rows.select("month", "trade_date", "security_id", "factor_id", "factor_value"), base.select("month", "trade_date", "security_id", "industry_group", "sector"))


def graph(*nodes, edges=(), final=None):
    """Nodes as (id, type, config); edges as "a>b", in the order of b's inputs."""
    pairs = [e.split(">") for e in edges]
    return {"nodes": [{"id": i, "type": t, "config": c} for i, t, c in nodes], "edges": [{"source": a, "target": b, "target_handle": f"{k:03d}"} for k, (a, b) in enumerate(pairs)], "outputs": {"final_node_id": final or nodes[-1][0]}}


A, B, H = ("a", "factor_input", {"factor_id": "mom_1m"}), ("b", "factor_input", {"factor_id": "high_gap"}), ("h", "factor_input", {"factor_id": "na_ratio"})


def one(kind, config=None):
    return graph(A, ("x", kind, config or {}), edges=["a>x"])


def two(kind, config=None):
    return graph(A, B, ("x", kind, config or {}), edges=["a>x", "b>x"])


_none = "NULL::VARCHAR"
_in = lambda f: f"SELECT trade_date, security_id, factor_value AS v FROM snaps WHERE factor_id = '{f}'"
_CTE = FACTORS | {"a": _in("mom_1m"), "b": _in("high_gap"), "h": _in("na_ratio"), "base": "SELECT DISTINCT trade_date, security_id, industry_group, sector FROM snaps JOIN security_master USING (security_id)"}
_AB = "SELECT trade_date, security_id, a.v AS v0, b.v AS v1 FROM a JOIN b USING (trade_date, security_id)"
_AG = "SELECT trade_date, security_id, v, sector, industry_group FROM a JOIN base USING (trade_date, security_id)"
_IT = "OVER (PARTITION BY security_id ORDER BY trade_date"


def node(value, source, reason=_none):
    return f"SELECT trade_date, security_id, CASE WHEN r IS NULL THEN x END AS value, r IS NULL AS is_valid, r AS invalid_reason FROM (SELECT trade_date, security_id, x, coalesce(r, CASE WHEN x IS NULL THEN 'source_null' END) AS r FROM (SELECT trade_date, security_id, CAST({value} AS DOUBLE) AS x, {reason} AS r FROM ({source})))"


def _q(p, by):
    return f"SELECT {by}, list_sort(list(v))[CAST(least(count(*), floor(count(*) * {p}) + 1) AS BIGINT)] AS q FROM ({_AG}) GROUP BY ALL"


_ORD = "row_number() OVER (PARTITION BY trade_date ORDER BY v {o}, security_id)"
_N = "count(*) OVER (PARTITION BY trade_date)"
_Z = "(v - avg(v) OVER w) / nullif(stddev_pop(v) OVER w, 0)"
DEFINITIONS = {
    "factor_input": (graph(A), node("v", "a")),
    "factor_input_median": (graph(("a", "factor_input", {"factor_id": "mom_1m", "missing": "median"})), node("coalesce(v, q)", "SELECT trade_date, security_id, v, q FROM base LEFT JOIN a USING (trade_date, security_id) LEFT JOIN (SELECT trade_date, list_sort(list(v))[CAST(least(count(*), floor(count(*) * 0.5) + 1) AS BIGINT)] AS q FROM a GROUP BY 1) USING (trade_date)")),
    "constant": (graph(("x", "constant", {"value": 2.5})), node("2.5", "base")),
    "add": (two("add"), node("v0 + v1", _AB)),
    "subtract": (two("subtract"), node("v0 - v1", _AB)),
    "multiply": (two("multiply"), node("v0 * v1", _AB)),
    "divide": (two("divide"), node("v0 / nullif(v1, 0)", _AB, "CASE WHEN v1 = 0 THEN 'division_by_zero' END")),
    "compare": (two("compare", {"op": ">"}), node("v0 > v1", _AB)),
    "and": (graph(A, B, ("c", "compare", {"op": ">"}), ("e", "compare", {"op": "<"}), ("x", "and", {"op": "and"}), edges=["a>c", "b>c", "a>e", "b>e", "c>x", "e>x"]), node("0", _AB)),
    "or": (graph(A, B, ("c", "compare", {"op": ">"}), ("e", "compare", {"op": "<"}), ("x", "or", {"op": "or"}), edges=["a>c", "b>c", "a>e", "b>e", "c>x", "e>x"]), node("v0 <> v1", _AB)),
    "condition": (graph(A, B, ("c", "compare", {"op": ">"}), ("x", "condition", {}), edges=["a>c", "b>c", "a>x", "c>x"]), node("v", "SELECT trade_date, security_id, a.v, coalesce(a.v > b.v, false) AS met FROM a LEFT JOIN b USING (trade_date, security_id)", "CASE WHEN NOT met THEN 'condition_not_met' END")),
    "condition_score": (graph(A, B, ("c", "compare", {"op": ">"}), ("x", "condition_score", {"met": 10, "unmet": 1}), edges=["a>c", "b>c", "c>x"]), node("CASE WHEN v0 > v1 THEN 10 ELSE 1 END", f"SELECT trade_date, security_id, v0, v1 FROM base LEFT JOIN ({_AB}) USING (trade_date, security_id)")),
    "log": (one("log", {"op": "log"}), node("CASE WHEN v > 0 THEN ln(v) END", "a", "CASE WHEN v <= 0 THEN 'log_domain' END")),
    "sqrt": (one("sqrt", {"op": "sqrt"}), node("CASE WHEN v >= 0 THEN sqrt(v) END", "a", "CASE WHEN v < 0 THEN 'sqrt_domain' END")),
    "abs": (one("abs", {"op": "abs"}), node("abs(v)", "a")),
    "negate": (one("negate", {"op": "negate"}), node("-v", "a")),
    "winsorize": (one("winsorize", {"low": 0.1, "high": 0.9}), node("greatest(lo, least(hi, v))", f"SELECT trade_date, security_id, v, l.q AS lo, u.q AS hi FROM a JOIN ({_q(0.1, 'trade_date')}) l USING (trade_date) JOIN ({_q(0.9, 'trade_date')}) u USING (trade_date)")),
    "zscore": (one("zscore", {"clip": 2, "min_count": 3}), node("greatest(-2.0, least(2.0, z))", f"SELECT trade_date, security_id, CASE WHEN count(v) OVER w >= 3 THEN {_Z} END AS z FROM a WINDOW w AS (PARTITION BY trade_date)", "CASE WHEN z IS NULL THEN 'zscore_zero_std' END").replace("greatest(-2.0, least(2.0, z))", "CASE WHEN z IS NOT NULL THEN greatest(-2.0, least(2.0, z)) END")),
    "shrunk_zscore": (one("shrunk_zscore", {"strength": 10.0, "min_count": 3}), node("CASE WHEN n >= 3 AND own IS NOT NULL THEN n / (n + 10.0) * own + (1 - n / (n + 10.0)) * m ELSE m END", f"""SELECT trade_date, security_id, CAST(count(v) OVER w AS DOUBLE) AS n, CASE WHEN count(v) OVER w >= 2 THEN {_Z} END AS own, CASE WHEN count(v) OVER u >= 2 THEN {_Z.replace('OVER w', 'OVER u')} END AS m
        FROM ({_AG}) WINDOW w AS (PARTITION BY trade_date, sector), u AS (PARTITION BY trade_date)""", "CASE WHEN m IS NULL AND NOT coalesce(n >= 3 AND own IS NOT NULL, false) THEN 'zscore_min_count' END")),
    "neutralize": (one("neutralize", {"scope": "sector"}), node("v - avg(v) OVER (PARTITION BY trade_date, sector)", _AG)),
    "rank": (one("rank", {"op": "rank"}), node(_ORD.format(o="DESC"), "a")),
    "dense_rank": (one("dense_rank", {"op": "dense_rank", "descending": False}), node(_ORD.format(o="ASC"), "a")),
    "percent_rank": (one("percent_rank", {"op": "percent_rank"}), node(f"CASE WHEN {_N} = 1 THEN 0.0 ELSE ({_ORD.format(o='DESC')} - 1) / ({_N} - 1) END", "a")),
    "dense_score": (one("dense_score", {"op": "dense_score"}), node(f"CASE WHEN {_N} = 1 THEN 100.0 ELSE ({_ORD.format(o='ASC')} - 1) / ({_N} - 1) * 100 END", "a")),
    "dense_score_average": (one("dense_score", {"op": "dense_score", "ties": "average"}), node(f"CASE WHEN {_N} = 1 THEN 100.0 ELSE (rank() OVER (PARTITION BY trade_date ORDER BY v) + (count(*) OVER (PARTITION BY trade_date, v) - 1) / 2.0 - 1) / ({_N} - 1) * 100 END", "a")),
    "bucket": (one("bucket", {"op": "bucket", "buckets": 4}), node("ntile(4) OVER (PARTITION BY trade_date ORDER BY v DESC, security_id)", "a")),
    "lag": (one("lag", {"periods": 3}), node(f"lag(v, 3) {_IT})", "a", f"CASE WHEN row_number() {_IT}) <= 3 THEN 'lag_insufficient_history' END")),
    "rolling_max": (one("rolling_max", {"op": "max", "window": 6}), node(f"max(v) {_IT} ROWS 5 PRECEDING)", "a", f"CASE WHEN count(*) {_IT} ROWS 5 PRECEDING) < 6 THEN 'rolling_insufficient_history' END")),
    "rolling_min": (one("rolling_min", {"op": "min", "window": 6}), node(f"min(v) {_IT} ROWS 5 PRECEDING)", "a", f"CASE WHEN count(*) {_IT} ROWS 5 PRECEDING) < 6 THEN 'rolling_insufficient_history' END")),
    "weighted_score": (two("weighted_score", {"weights": [0.6, 0.4]}), node("v0 * 0.6::DOUBLE + v1 * 0.4::DOUBLE", _AB)),
    "weighted_renormalized": (two("weighted_score", {"weights": [0.6, 0.4], "renormalize": True}), node("(coalesce(v0 * 0.6::DOUBLE, 0) + coalesce(v1 * 0.4::DOUBLE, 0)) / nullif(w, 0)", "SELECT trade_date, security_id, a.v AS v0, b.v AS v1, CASE WHEN a.v IS NULL THEN 0 ELSE 0.6::DOUBLE END + CASE WHEN b.v IS NULL THEN 0 ELSE 0.4::DOUBLE END AS w FROM base LEFT JOIN a USING (trade_date, security_id) LEFT JOIN b USING (trade_date, security_id)", "CASE WHEN w = 0 THEN 'no_active_weight' END")),
    "nested": (graph(A, B, H, ("s", "add", {}), ("n", "neutralize", {"scope": "sector"}), ("x", "divide", {}), edges=["a>s", "b>s", "s>n", "n>x", "h>x"]), node("n / nullif(hv, 0)", f"SELECT trade_date, security_id, n, h.v AS hv FROM (SELECT trade_date, security_id, s - avg(s) OVER (PARTITION BY trade_date, sector) AS n FROM (SELECT trade_date, security_id, v0 + v1 AS s FROM ({_AB})) JOIN base USING (trade_date, security_id)) JOIN h USING (trade_date, security_id)", "CASE WHEN hv = 0 THEN 'division_by_zero' END")),
}


def _query(definition):
    def query(spark, d):
        out = g.run(definition, context(spark, d))
        return out.withColumn("value", F.round("value", 10))

    return query


def graph_quality(spark, d):
    return g.quality(g.run(DEFINITIONS["log"][0], context(spark, d)))


def graph_reasons(spark, d):
    return g.reasons(g.run(DEFINITIONS["condition"][0], context(spark, d)))


LOOKS_BACK = graph(A, B, ("l", "lag", {"periods": 3}), ("m", "rolling_max", {"op": "max", "window": 6}), ("s", "subtract", {}), ("z", "zscore", {"scope": "sector"}), ("x", "add", {}), edges=["a>l", "b>s", "l>s", "s>z", "b>m", "z>x", "m>x"])


def _last_dates(c, k):
    """The last k dates of the snapshots, at most one row a date."""
    return sorted(r.trade_date for r in c.factors.select("trade_date").distinct().orderBy(F.desc("trade_date")).limit(k).collect())


def graph_at_dates(spark, d):
    """Three dates of a graph that looks back: temporal inputs read the past, the others these dates."""
    c = context(spark, d)
    return g.run_dates(LOOKS_BACK, c, _last_dates(c, 3)).withColumn("value", F.round("value", 9))


def graph_at_one_date(spark, d):
    """One date: a lag reads its few rows of each security only; strict, as every factor has its snapshot."""
    c = context(spark, d)
    return g.run_dates(one("lag", {"periods": 3}), c, _last_dates(c, 1), strict=True).withColumn("value", F.round("value", 10))


def graph_uncovered_dates(spark, d):
    """The dates among all month ends at which some input has no snapshot, where one factor stopped in 1997."""
    c = context(spark, d)
    factors = c.factors.where("factor_id <> 'high_gap' OR trade_date < DATE'1997-01-01'")
    dates = [r.trade_date for r in c.factors.select("trade_date").distinct().collect()]
    gaps = g.uncovered_dates(two("add"), factors, dates)
    return spark.createDataFrame([(x,) for x in gaps], "trade_date date")


QUERIES = {"graph_at_dates": graph_at_dates, "graph_at_one_date": graph_at_one_date, "graph_uncovered_dates": graph_uncovered_dates} | {f"graph_{name}": _query(definition) for name, (definition, _) in DEFINITIONS.items()} | {"graph_quality": graph_quality, "graph_reasons": graph_reasons}
_sql = lambda body: sql("price_daily security_master", body, **_CTE)
_LAGGED = f"SELECT trade_date, security_id, lag(v, 3) {_IT}) AS lv, row_number() {_IT}) AS p FROM a"
_MAXED = f"SELECT trade_date, security_id, max(v) {_IT} ROWS 5 PRECEDING) AS mv, count(*) {_IT} ROWS 5 PRECEDING) AS c FROM b"
_LB = {"lagged": _LAGGED, "maxed": _MAXED,
       "su": "SELECT trade_date, security_id, b.v, CASE WHEN p > 3 THEN b.v - lv END AS s, CASE WHEN p <= 3 THEN 'lag_insufficient_history' END AS why FROM b JOIN lagged USING (trade_date, security_id)",
       "zz": "SELECT trade_date, security_id, (s - avg(s) OVER w) / nullif(stddev_pop(s) OVER w, 0) AS z, count(s) OVER w AS n, why FROM su JOIN base USING (trade_date, security_id) WINDOW w AS (PARTITION BY trade_date, sector)",
       "xx": "SELECT trade_date, security_id, CASE WHEN n >= 2 THEN z END AS z, mv, coalesce(why, CASE WHEN n < 2 OR z IS NULL THEN 'zscore_zero_std' END, CASE WHEN c < 6 THEN 'rolling_insufficient_history' END) AS r FROM zz JOIN maxed USING (trade_date, security_id)"}
_LAST3 = "(SELECT DISTINCT trade_date FROM snaps ORDER BY trade_date DESC LIMIT {k})"
SQL = {
    "graph_at_dates": sql("price_daily security_master", f"SELECT trade_date, security_id, CASE WHEN r IS NULL THEN round(z + mv, 9) END AS value, r IS NULL AS is_valid, r AS invalid_reason FROM xx WHERE trade_date IN {_LAST3.format(k=3)}", **_CTE, **_LB),
    "graph_at_one_date": _sql(f"SELECT * REPLACE (round(value, 10) AS value) FROM ({DEFINITIONS['lag'][1]}) WHERE trade_date IN {_LAST3.format(k=1)}"),
    "graph_uncovered_dates": _sql("SELECT trade_date FROM snaps GROUP BY 1 HAVING count(*) FILTER (WHERE factor_id = 'mom_1m') = 0 OR count(*) FILTER (WHERE factor_id = 'high_gap' AND trade_date < DATE '1997-01-01') = 0"),
} | {f"graph_{name}": _sql(f"SELECT * REPLACE (round(value, 10) AS value) FROM ({text})") for name, (_, text) in DEFINITIONS.items()} | {
    "graph_quality": _sql(f"SELECT count(*) AS n_rows, count(*) FILTER (WHERE is_valid) AS n_valid, count(*) FILTER (WHERE NOT is_valid) AS n_invalid, count(DISTINCT security_id) AS n_securities, min(trade_date) AS first_date, max(trade_date) AS last_date FROM ({DEFINITIONS['log'][1]})"),
    "graph_reasons": _sql(f"SELECT invalid_reason, count(*) AS n_rows FROM ({DEFINITIONS['condition'][1]}) WHERE NOT is_valid GROUP BY 1"),
}
