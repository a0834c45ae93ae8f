"""Query registry: a name, a Spark plan over the lake and, where SQL can say it, the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskfabric.bindings import Lake, oracle_text

Plan = Callable[[Lake], DataFrame]

_PLANS: dict[str, Plan] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Plan], Plan]:
    def add(plan: Plan) -> Plan:
        if name in _PLANS:
            raise ValueError(f"duplicate query {name}")
        _PLANS[name] = plan
        if sql is not None:
            _ORACLES[name] = sql
        return plan

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, path: plan(Lake(spark, path))

    return {name: bind(plan) for name, plan in _PLANS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: oracle_text(sql) for name, sql in _ORACLES.items()}


def rounded(expr: str, places: int = 6) -> str:
    """SQL for half-up rounding by floor, equal in both engines bit for bit."""
    return f"floor(({expr}) * 1e{places} + 0.5) / 1e{places}"
