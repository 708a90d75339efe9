"""Plan contracts: no Python evaluation in the hot path, no unpartitioned window on rows."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
HOT = ["standardize_units", "grain_safe_join", "compliance_rollup", "composite_index", "last_non_null", "previous_visit", "rank_average", "co_measurement"]


@pytest.mark.parametrize("name", HOT)
def test_no_python_nodes(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().toString()
    assert "EvalPython" not in plan and "InPandas" not in plan and "CartesianProduct" not in plan


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
