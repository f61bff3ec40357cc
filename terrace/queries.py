"""The registered queries outside the training-data subpackage, each with its oracle."""

from __future__ import annotations

from .plans import analysis_queries, change_queries, check_queries, column_queries, join_queries, kpi_queries, likeness_queries, model_queries, place_queries, rule_queries, window_queries  # noqa: F401  these register their queries
from .plans.catalogue import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
