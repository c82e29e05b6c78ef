"""All queries of the library but those of the optional subpackage."""

from __future__ import annotations

from . import cascade_queries, context_queries, document_queries, followup_queries, matching_queries, record_queries, rule_queries, stream_queries, text_queries

MODULES = [matching_queries, cascade_queries, context_queries, document_queries, followup_queries, record_queries, rule_queries, text_queries, stream_queries]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
ORACLES = {k: v for m in MODULES for k, v in m.ORACLES.items()}
