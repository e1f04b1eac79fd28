"""Every query of the engine's own operators, with the SQL that checks it."""

from __future__ import annotations

from .plans import alignment_queries, catalog_queries, constraint_queries, detail_queries, document_queries, evidence_queries, explorer_queries, rule_queries, sync_queries, tree_queries, value_queries

MODULES = (sync_queries, explorer_queries, catalog_queries, value_queries, rule_queries, document_queries, tree_queries, alignment_queries, evidence_queries, constraint_queries, detail_queries)

QUERIES = {name: query for m in MODULES for name, query in m.C.queries.items()}
SQL = {name: sql for m in MODULES for name, sql in m.C.sql.items()}
