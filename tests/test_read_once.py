"""Recent listings are made once, though both sides of a join read them."""

import pytest

import __spark_entry__ as entry


@pytest.mark.parametrize("name", ["suppress", "deterministic_score", "combined_score", "verdict_distribution"])
def test_lineitem_is_not_read_by_both_sides(spark, name):
    plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan
