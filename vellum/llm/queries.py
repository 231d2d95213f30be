"""Registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from vellum.llm import bpe_queries, chat_queries, corpus_queries, dedup_queries, filter_queries, integrity_queries, quality_queries

MODULES = [dedup_queries, filter_queries, corpus_queries, chat_queries, bpe_queries, quality_queries, integrity_queries]
QUERIES = {name: query for module in MODULES for name, query in module.QUERIES.items()}
ORACLES = {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
