"""All named queries and their oracle SQL."""

from __future__ import annotations

from epochfold.plans import eval_queries, signal_queries


def queries() -> dict:
    return {**signal_queries.QUERIES, **eval_queries.QUERIES}


def oracle_sql() -> dict[str, str]:
    return {**signal_queries.ORACLE, **eval_queries.ORACLE}
