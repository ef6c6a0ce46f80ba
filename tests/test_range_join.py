"""Near pairs against every pair."""

import random

import pytest
from pyspark.sql import functions as F

from stallmark.operators.range_join import Near, near_medians, near_pairs


def holds(n, a, b):
    return a is None or b is None or abs(a - b) <= max(n.reach, a * n.share)


@pytest.mark.parametrize("unknown", [0.0, 0.2])
def test_equals_every_pair(spark, unknown):
    r = random.Random(4)
    mileage = lambda: r.choice([r.uniform(0, 90_000), r.uniform(80_000, 95_000), 10 ** r.uniform(3, 6), 30_000.0 * r.randint(0, 9), 0.0, -5.0])
    some = lambda v: None if r.random() < unknown else v
    rows = [(f"l{i}", r.choice(["gol", "gol", "civic", None]), some(r.randint(1990, 2010)), some(mileage())) for i in range(260)]
    near = [Near("year", 2), Near("mileage", 30_000, 0.35)]
    df = spark.createDataFrame(rows, "listing_id string, model string, year int, mileage double").repartition(4)
    targets = df.where("listing_id like '%1' or listing_id like '%2' or listing_id like '%3'")
    want = sorted((a[0], b[0]) for a in rows for b in rows if a[0][-1] in "123" and a[0] != b[0] and a[1] and a[1] == b[1] and holds(near[0], a[2], b[2]) and holds(near[1], a[3], b[3]))
    for most in (10, 20_000):
        got = near_pairs(targets, df, ["model"], near, most=most).selectExpr("target.listing_id a", "candidate.listing_id b")
        assert sorted(map(tuple, got.collect())) == want  # each pair once
    assert near_pairs(targets.limit(0), df, ["model"], near).count() == 0 == near_pairs(targets, df.limit(0), ["model"], near).count()


def test_rows_that_meet_follow_the_pairs(spark):
    """20,000 cars of one model: a target probes so few cells that what it meets is within six times what is near."""
    df = spark.range(20_000).selectExpr("cast(id as string) listing_id", "1960 + pmod(hash(id), 40) year", "exp(7 + pmod(hash(id, 1), 100000) / 100000 * 6) mileage").cache()
    near = [Near("year", 2), Near("mileage", 30_000, 0.35)]
    probes = df.where("listing_id like '%7'").select("listing_id", "year", "mileage", F.explode(near[0].probes(F.col("year").cast("double"))).alias("a")).withColumn("b", F.explode(near[1].probes(F.col("mileage"))))
    cells = df.select(F.get(near[0].lies_in(F.col("year").cast("double"), False), F.lit(0)).alias("a"), F.get(near[1].lies_in(F.col("mileage"), False), F.lit(0)).alias("b"), F.col("year").alias("y"), F.col("mileage").alias("m"))
    met, kept = probes.join(cells, ["a", "b"]).agg(F.count("*"), F.count_if(near[0].holds(F.col("year"), F.col("y")) & near[1].holds(F.col("mileage"), F.col("m")))).first()
    assert 0 < kept and met < 6 * kept and kept < 0.2 * 2000 * 20_000


def test_reach_is_positive():
    with pytest.raises(ValueError):
        Near("year", 0)


@pytest.mark.parametrize("unknown", [0.0, 0.2])
def test_medians_equal_those_of_pairs(spark, unknown):
    r = random.Random(5)
    mileage = lambda: r.choice([r.uniform(0, 90_000), r.uniform(80_000, 95_000), 10 ** r.uniform(3, 6), 30_000.0 * r.randint(0, 9), 0.0, -5.0])
    some = lambda v: None if r.random() < unknown else v
    rows = [(i, r.choice(["gol", "gol", "civic", None]), some(r.randint(1990, 2010)), some(mileage()), some(float(r.randint(1, 50)))) for i in range(260)]
    near = [Near("year", 2), Near("mileage", 30_000, 0.35)]
    df = spark.createDataFrame(rows, "at long, model string, year int, mileage double, price double").repartition(4)
    targets, pool = df.where("at % 3 <> 0").drop("price"), df.where("at % 4 <> 0")
    pairs = near_pairs(targets, pool, ["model"], near, id_col="at")
    want = pairs.groupBy("target.at").agg(F.count("*").alias("n"), F.median("candidate.price").alias("m")).collect()
    for most in (5, 4_000):
        got = near_medians(targets, pool, ["model"], near, "price", "at", most).select("at", "n", "median")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and len(want) > 100
    assert near_medians(targets, pool.limit(0), ["model"], near, "price", "at").count() == 0
