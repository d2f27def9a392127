"""All registered queries of the library itself."""

from __future__ import annotations

from emberlog.plans import flow_queries, log_queries, report_queries, stream_queries, text_queries  # noqa: F401
from emberlog.plans.base import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
