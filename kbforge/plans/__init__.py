"""Composed plans and the registry of named queries."""

from kbforge.plans import answer_queries, eval_queries, graph_queries, ingest_queries, page_answers, search_queries  # noqa: F401  (registers queries)
from kbforge.plans.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
