"""Imports every module that registers queries."""

from quillon.plans import flow_queries, join_queries, more_queries, page_queries, review_queries, rule_queries, sequence_queries, source_queries, text_queries  # noqa: F401
from quillon.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
