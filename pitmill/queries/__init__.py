"""Registered queries over the driver tables, and their SQL.

Each module of this package has QUERIES (name -> function of session and folder)
and SQL (name -> DuckDB text over the same tables).
"""

from __future__ import annotations

from . import accounts, backtests, capital, consensus_views, country_risk, daily_rows, deepen, event_streams, extras, feeds, fundamentals, graphs, lab, market, metric_cells, pit_scores, provider_feeds, rules_quality, scoring

MODULES = (market, fundamentals, scoring, graphs, backtests, consensus_views, rules_quality, extras, feeds, pit_scores, lab, deepen, accounts, event_streams, country_risk, capital, metric_cells, daily_rows, provider_feeds)
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
SQL = {name: text for module in MODULES for name, text in module.SQL.items()}
