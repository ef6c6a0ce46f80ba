"""Counters of a run equal counts made afterwards, in one action."""

from pyspark.sql import functions as F

from stallmark.operators.runs import Counters, counted_run
from stallmark.schema import SUMMARY


def test_counters(spark):
    good = "https://sc.olx.com.br/a-1234567"
    rows = [(1, "olx", "1", "A", 5.0, "BRL", None, good, None), (2, "olx", "1", "A", 6.0, "BRL", None, good, None), (3, "olx", "2", " ", -1.0, "BRL", None, good, None), (4, "facebook", "3", "B", None, None, None, "https://www.facebook.com/marketplace/item/3", None), (5, "olx", "4", "C", None, "BRL", None, "https://example.com/x", None), (6, "olx", "5", "D", None, "BRL", None, good, None)]
    counters = Counters()
    out = counted_run(spark.createDataFrame(rows, SUMMARY).repartition(3), F.lit("olx"), lambda found: found.where("price is not null"), counters)
    assert [r.seq for r in out.collect()] == [1]
    got = {(r.stage, r.counter): r.n for r in counters.table(spark).collect()}
    assert {k: v for k, v in got.items() if v} == {("received", "rows"): 6, ("received", "rejected"): 3, ("received", "rejected_title"): 1, ("received", "rejected_price"): 1, ("received", "rejected_provider"): 1, ("received", "rejected_host"): 1, ("discovered", "rows"): 2, ("analysed", "rows"): 1}


def test_counting_adds_no_stage(spark):
    df = spark.range(100).selectExpr("id", "id % 7 k").groupBy("k").count()
    plan = lambda d: [x for x in d._jdf.queryExecution().executedPlan().toString().split() if x in ("Exchange", "Sort", "HashAggregate")]
    assert plan(Counters().at(df, "x", some=F.col("k") > 3)) == plan(df)
