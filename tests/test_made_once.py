"""What a row costs is worked out once: filters and further columns do not repeat it, and small tables are dealt to all cores."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    before = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "100000")
    try:
        return entry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", before)


@pytest.mark.parametrize(("name", "step", "most"), [("document_reasons", "json", 2), ("kept_answers", "json", 1), ("extraction_rejects", "translate(", 2), ("extract_vehicle", "translate(", 2), ("comparables_vehicle", "translate(", 6), ("comparables_eligible", "translate(", 3), ("inferred_models", "translate(", 2), ("places", "translate(", 2), ("gate_reasons", "HOST", 7)])
def test_a_costly_step_is_in_the_plan_once(spark, name, step, most):
    assert plan(spark, name).lower().count(step.lower()) <= most


@pytest.mark.parametrize("name", ["document_reasons", "kept_answers", "extract_vehicle", "comparables_vehicle", "comparables_eligible", "inferred_models", "places", "details_reasons"])
def test_work_on_a_small_table_is_dealt_out(spark, name):
    assert "RepartitionByExpression" in plan(spark, name)
