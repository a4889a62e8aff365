"""All queries of the engine (without the corpus operators) and their SQL."""

from __future__ import annotations

from . import analytics_queries, case_queries, detector_queries, feature_queries, fusion_queries, graph_queries, report_queries, stream_queries  # noqa: F401  they register their queries
from .registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
