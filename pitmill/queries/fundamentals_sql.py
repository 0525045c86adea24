"""SQL of the statement ratios, scores and multiples, written by hand: it shares no formula with the Spark queries."""

from __future__ import annotations

from collections.abc import Mapping

from ..sources.views import sql

_NOW = "SALE NI TA SEQ ACT LCT RECT INVT COGS SGA CFO DLTT DLC PPENT DP CHE RE XINT CAPX DIV".split()
#: Trailing periods (n) beside those of four and twelve rows before (b, c).
_ROWS = "SELECT security_id, fiscal_year, fiscal_month, " + ", ".join(f"{x} AS {x.lower()}, lag({x}, 4) OVER o AS {x.lower()}_b" for x in _NOW) + ", lag(SALE, 12) OVER o AS sale_c FROM ttm WINDOW o AS (PARTITION BY security_id ORDER BY fiscal_year, fiscal_month)"


def ratio_sql(periods: Mapping[str, str]) -> dict[str, str]:
    def of(**columns: str) -> str:
        return sql("statements", "SELECT security_id, fiscal_year, fiscal_month, " + ", ".join(f"round({text}, 6) AS {name}" for name, text in columns.items()) + " FROM n", **periods, n=_ROWS)

    flag = lambda test: f"(CASE WHEN {test} THEN 1 ELSE 0 END)"
    oi, ebitda = "(sale - cogs - sga)", "(sale - cogs - sga + dp)"
    mean_assets, mean_equity = "nullif((ta + ta_b) / 2, 0)", "nullif((seq + seq_b) / 2, 0)"
    capital = "nullif(greatest(ta - lct - che, 0), 0)"
    index = {
        "dsri": "(rect / nullif(sale, 0)) / nullif(rect_b / nullif(sale_b, 0), 0)",
        "gmi": "((sale_b - cogs_b) / nullif(sale_b, 0)) / nullif((sale - cogs) / nullif(sale, 0), 0)",
        "aqi": "(1 - (act + ppent) / nullif(ta, 0)) / nullif(1 - (act_b + ppent_b) / nullif(ta_b, 0), 0)",
        "sgi": "sale / nullif(sale_b, 0)",
        "depi": "(dp_b / nullif(dp_b + ppent_b, 0)) / nullif(dp / nullif(dp + ppent, 0), 0)",
        "sgai": "(sga / nullif(sale, 0)) / nullif(sga_b / nullif(sale_b, 0), 0)",
        "tata": "(ni - cfo) / nullif(ta, 0)",
        "lvgi": "((dltt + dlc) / nullif(ta, 0)) / nullif((dltt_b + dlc_b) / nullif(ta_b, 0), 0)",
    }
    weight = {"dsri": 0.92, "gmi": 0.528, "aqi": 0.404, "sgi": 0.892, "depi": 0.115, "sgai": -0.172, "tata": 4.679, "lvgi": -0.327}
    margin = lambda a, b: f"({a}) / nullif({b}, 0) * 100"
    return {
        "annual_margins": of(oi=oi, gpm=margin("sale - cogs", "sale"), opm=margin(oi, "sale"), ebitda_margin=margin(ebitda, "sale"), npm=margin("ni", "sale"), fcf_margin=margin("cfo - capx", "sale")),
        "returns_on_capital": of(oi=oi, roe=f"ni / {mean_equity} * 100", roa=f"ni / {mean_assets} * 100", nopat=f"{oi} * 0.79", invested="ta - lct - che", roic=f"{oi} * 0.79 / {capital} * 100", accrual_ratio=f"(ni - cfo) / {mean_assets} * 100"),
        "efficiency": of(asset_turnover=f"sale / {mean_assets}", inventory_days="invt * 365 / nullif(cogs, 0)", receivable_days="rect * 365 / nullif(sale, 0)", working_capital="act - lct", ccc="invt * 365 / nullif(cogs, 0) + rect * 365 / nullif(sale, 0)"),
        "leverage": of(ebitda=ebitda, net_debt_to_ebitda=f"(dltt + dlc - che) / nullif(greatest({ebitda}, 0), 0)", icr=f"{oi} / nullif(xint, 0)", current_ratio="act / nullif(lct, 0)", debt_to_equity="(dltt + dlc) / nullif(greatest(seq, 0), 0)", cash_to_debt="che / nullif(dltt + dlc, 0)"),
        "altman": of(altman_base=f"(1.2 * (act - lct) + 1.4 * re + 3.3 * {oi} + sale) / nullif(ta, 0)"),
        "beneish": of(**index, m_score="-4.84 + " + " + ".join(f"{w} * ({index[k]})" for k, w in weight.items())),
        "piotroski": of(f_score=" + ".join(map(flag, (
            "ni > 0", "cfo > 0", "ni / nullif(ta, 0) > ni_b / nullif(ta_b, 0)", "cfo > ni", "dltt * ta_b < dltt_b * ta", "act * lct_b > act_b * lct", "seq_b >= seq", "cogs / nullif(sale, 0) < cogs_b / nullif(sale_b, 0)", "sale / nullif(ta, 0) > sale_b / nullif(ta_b, 0)",
        )))),
        "growth_suite": of(sale_yoy="(sale - sale_b) / nullif(sale_b, 0) * 100", ni_growth="(ni - ni_b) / nullif(abs(ni_b), 0) * 100", ni_profit_growth="CASE WHEN sign(ni) = sign(ni_b) AND ni <> 0 THEN (ni - ni_b) / abs(ni_b) * 100 END", asset_growth="(ta - ta_b) / nullif(ta_b, 0) * 100", sale_cagr_3y="CASE WHEN least(sale, sale_c) > 0 THEN (exp(ln(sale / sale_c) / 3) - 1) * 100 END"),
    }


def valuation_sql(periods: Mapping[str, str], daily: Mapping[str, str]) -> str:
    return sql("statements price_daily shares_monthly", """SELECT security_id, trade_date, round(e, 9) AS eps, round(b, 9) AS bps, round(CASE WHEN e > 0 THEN close / e END, 9) AS per, round(CASE WHEN b > 0 THEN close / b END, 9) AS pbr, round(CASE WHEN SALE > 0 THEN close * shares / SALE END, 9) AS psr, round(CASE WHEN CFO > 0 THEN close * shares / CFO END, 9) AS pcr,
        round(CASE WHEN close * shares > 0 THEN 100 * DIV / (close * shares) END, 9) AS dividend_yield, round(CASE WHEN SALE + DP > COGS + SGA THEN ev / (SALE - COGS - SGA + DP) END, 9) AS ev_to_ebitda,
        CASE WHEN close IS NULL OR shares IS NULL THEN 'no_market_cap' WHEN ev IS NULL THEN 'no_statement' WHEN ev <= 0 THEN 'negative_ev' ELSE 'ok' END AS ev_flag
        FROM (SELECT *, CASE WHEN shares > 0 THEN NI / shares END AS e, CASE WHEN shares > 0 THEN SEQ / shares END AS b, close * shares + DLTT + DLC - CHE AS ev FROM daily)""", **periods, **daily)
