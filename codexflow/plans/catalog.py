"""The catalogue of named queries and their SQL."""

from __future__ import annotations

from codexflow.plans import functions_queries, mutation_queries, record_queries, source_queries, store_queries, work_queries, workflow_queries  # noqa: F401
from codexflow.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
