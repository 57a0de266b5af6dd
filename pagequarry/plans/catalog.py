"""All registered queries and their oracles."""

from __future__ import annotations

from pagequarry.plans import document_queries, ingest_queries, page_queries, search_queries, state_queries, store_queries

_AREAS = (search_queries, document_queries, page_queries, store_queries, ingest_queries, state_queries)
QUERIES = {name: fn for area in _AREAS for name, fn in area.QUERIES.items()}
ORACLES = {name: sql for area in _AREAS for name, sql in area.ORACLES.items()}
