"""Every query of the treasury engine by name, with its SQL."""

from __future__ import annotations

from ledgerlake.plans import company_queries, mapping_queries, panel_queries, risk_queries, scorer_queries, serving_queries, storage_queries, text_queries

_MODULES = (mapping_queries, panel_queries, risk_queries, serving_queries, company_queries, scorer_queries, storage_queries, text_queries)
QUERIES: dict = {name: q for m in _MODULES for name, q in m.QUERIES.items()}
ORACLE_SQL: dict = {name: q for m in _MODULES for name, q in m.ORACLE_SQL.items()}
