"""Registered queries."""

from weft.plans import audit_queries, composite_queries, media_queries, mixture_queries, report_queries, span_queries, stat_queries
from weft.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "audit_queries", "composite_queries", "media_queries", "mixture_queries", "report_queries", "span_queries", "stat_queries"]
