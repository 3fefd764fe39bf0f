"""All registered queries of the library proper."""

from __future__ import annotations

from . import catalogue_queries, dedup_queries, fact_queries, line_queries, merge_queries, other_queries, text_queries, thread_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
