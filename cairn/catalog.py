"""Every registered query and its SQL."""

from __future__ import annotations

from .plans import curation_queries, knowledge_queries, learning_queries, metrics_queries, search_queries, text_queries, upkeep_queries

MODULES = (metrics_queries, search_queries, learning_queries, curation_queries, text_queries, knowledge_queries, upkeep_queries)
QUERIES = {k: f for m in MODULES for k, f in m.query.queries.items()}
ORACLE_SQL = {k: s for m in MODULES for k, s in m.query.sql.items()}
