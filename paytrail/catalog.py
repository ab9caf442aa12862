"""Registered queries of the engine and their DuckDB SQL."""

from __future__ import annotations

from paytrail.plans import case_queries, ledger_queries, report_queries, service_queries, text_queries  # noqa: F401  (register)
from paytrail.plans.registry import ORACLES, QUERIES


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
