"""All registered queries."""

from __future__ import annotations

from riskfabric.plans import aggregates, graphs, joins, landing, scalar, streams, trained, windows  # noqa: F401
from riskfabric.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
