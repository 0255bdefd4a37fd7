"""Queries of the engine and the SQL that must give the same rows."""

from __future__ import annotations

from provenia.plans import delivery_queries, record_queries, sheet_queries, text_queries  # they register theirs
from provenia.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "delivery_queries", "record_queries", "sheet_queries", "text_queries"]
