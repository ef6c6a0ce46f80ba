"""Percentiles by histograms against Spark's own."""

import math
import random

from pyspark.sql import functions as F

from stallmark.operators.selection import exact_percentiles, from_ordered_bits, ordered_bits

SHARES = [0.0, 0.25, 0.5, 0.75, 0.9, 1.0]


def test_bits_keep_the_order(spark):
    values = sorted([0.0, -0.0, 1.5, -1.5, 1e300, -1e300, 5e-324, -5e-324, math.inf, -math.inf, 3.0, 2.9999999999999996])
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", ordered_bits(F.col("v")).alias("b")).withColumn("back", from_ordered_bits(F.col("b"))).collect()
    assert all((x.v < y.v) == (x.b < y.b) for x in rows for y in rows) and all(r.v == r.back for r in rows)


def test_equals_percentile(spark):
    r = random.Random(7)
    rows = [("hot", "a", r.choice([r.gauss(0, 1000), float(r.randint(0, 50)), 10 ** r.uniform(-9, 9)])) for _ in range(3000)]
    rows += [("hot", None, r.random()) for _ in range(501)] + [(None, "b", float(r.randint(-3, 3))) for _ in range(400)]
    rows += [("one", "a", 4.0), ("two", "a", 1.0), ("two", "a", 2.0), ("none", "a", None), ("nan", "a", math.nan), ("inf", "a", math.inf), ("inf", "a", 1.0), ("zero", "a", -0.0), ("zero", "a", 0.0)]
    rows += [("same", "a", 9.5)] * 300
    df = spark.createDataFrame(rows, "g string, h string, price double").repartition(5)
    want = df.where("not isnan(price)").groupBy("g", "h").agg(F.count("price").alias("n"), F.percentile("price", F.array(*map(F.lit, SHARES))).alias("p")).where("n > 0").collect()
    for few in (0, 100, 10_000):
        got = exact_percentiles(df, ["g", "h"], "price", SHARES, few=few).collect()
        assert {(x.g, x.h): (x.n, x.percentiles) for x in got} == {(x.g, x.h): (x.n, x.p) for x in want}


def test_no_window_over_a_whole_group(spark):
    df = spark.range(200_000).select(F.lit(1).alias("g"), (F.col("id") * 0.1).alias("price"))
    got = exact_percentiles(df, ["g"], "price", [0.5], few=1000).first()
    assert got.percentiles == [df.agg(F.percentile("price", 0.5)).first()[0]]
    assert exact_percentiles(df.limit(0), ["g"], "price", [0.5]).count() == 0
