"""Registered queries: every operator bound to the shared tables."""

from __future__ import annotations

from cellwave.workload.registry import all_queries, all_sql

__all__ = ["all_queries", "all_sql"]
