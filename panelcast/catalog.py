"""All queries of the library with the SQL that gives the same rows, by operator id."""

from __future__ import annotations

from panelcast.plans import data_queries, log_queries, model_queries, panel_queries, portfolio_queries, scoring_queries  # noqa: F401
from panelcast.plans.register import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
