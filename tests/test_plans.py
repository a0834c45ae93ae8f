"""Physical plans: no products of tables, filters and columns reach the scan, hot paths stay in the JVM."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from riskfabric.plans import catalog

# Small constant or scalar sides are joined by key or as scalar subqueries, so no plan needs a product.
PRODUCTS = ("CartesianProduct", "BroadcastNestedLoopJoin")
# Scores of the isolation forest come from a pandas UDF.
PYTHON = {"m2_anomaly_scores", "m4_threat_classifier"}
BATCH = [n for n in catalog.queries() if n[0] in "pjalwugm" and not n.endswith("_stream")]


def plan_of(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", BATCH)
def test_no_products_and_no_python(spark, small_dir, name):
    plan = plan_of(entry.queries()[name](spark, small_dir))
    assert not [p for p in PRODUCTS if p in plan]
    if name not in PYTHON:
        assert "Python" not in plan and "Pandas" not in plan


def test_scan_reads_only_what_is_used(spark, small_dir):
    plan = plan_of(entry.queries()["j15_detection_details"](spark, small_dir))
    assert "PushedFilters" in plan and "EqualTo(l_returnflag,R)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_discount:double,l_returnflag:string>" in plan


def test_flagship_prunes_columns(spark, small_dir):
    plan = plan_of(entry.queries()["l1_prioritized_risks"](spark, small_dir))
    assert "l_extendedprice" not in plan and "o_totalprice" not in plan
