"""The registered queries of the evaluation operators."""

from __future__ import annotations

from evalloom.plans import check_queries, scoring_queries, text_queries, workflow_queries

FLAGSHIP = "paired_result"
_MODULES = (scoring_queries, workflow_queries, text_queries, check_queries)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: text for m in _MODULES for name, text in m.ORACLE_SQL.items()}
