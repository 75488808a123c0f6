"""All registered queries."""

from __future__ import annotations

from wirelight.plans import (  # noqa: F401  (importing registers)
    alert_queries, document_queries, function_queries, log_queries, scope_queries, stream_queries,
)
from wirelight.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(sorted(QUERIES.items()))


def oracle_sql() -> dict[str, str]:
    return dict(sorted(ORACLES.items()))
