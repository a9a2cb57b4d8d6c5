"""All registered queries of the library, and their SQL."""

from __future__ import annotations

from . import anchor_queries, atom_queries, audit_queries, corpus_queries, decision_queries, diagnosis_queries, document_audit_queries, evaluation_queries, fuzzy_queries, intake_queries, knowledge_queries, message_queries, page_queries, record_queries, recovery_queries, rendering_queries, retrieval_queries, session_queries, source_queries, store_queries, structure_queries, trace_queries, turn_queries

MODULES = (anchor_queries, atom_queries, retrieval_queries, audit_queries, corpus_queries, decision_queries, diagnosis_queries, document_audit_queries, evaluation_queries, fuzzy_queries, intake_queries, knowledge_queries, message_queries, page_queries, record_queries, recovery_queries, rendering_queries, session_queries, source_queries, store_queries, structure_queries, trace_queries, turn_queries)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLE_SQL = {k: s for m in MODULES for k, s in m.ORACLE_SQL.items()}
