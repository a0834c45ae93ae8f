"""Registered queries of the training-data operators and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskfabric.llm import plans_corpus, plans_search, plans_text

PARTS = (plans_search, plans_text, plans_corpus)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: plan for part in PARTS for name, plan in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in PARTS for name, sql in part.ORACLES.items()}
