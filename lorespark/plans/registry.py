"""All registered queries and their SQL."""

from __future__ import annotations

from lorespark.plans import code_queries, document_queries, maintenance_queries, record_queries, sparql_queries, state_queries

_MODULES = (sparql_queries, document_queries, record_queries, maintenance_queries, code_queries, state_queries)
QUERIES = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLE_SQL = {k: v for m in _MODULES for k, v in m.ORACLE_SQL.items()}
