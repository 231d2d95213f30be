"""Queries over the test tables: one per operator, each with SQL that must agree where SQL can say it."""

from . import registry
from . import import_queries, link_queries, merge_queries, normalize_queries, plan_queries, scalar_queries, search_queries, source_queries  # noqa: F401  (each module registers its queries)

QUERIES = registry.QUERIES
ORACLES = registry.oracles()
