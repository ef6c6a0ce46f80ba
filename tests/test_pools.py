"""Matches within pools, found through their titles, against every pair."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stallmark.operators import matching
from stallmark.operators.comparables import pool_pairs

START = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(6)
    title = lambda: " ".join(r.sample(["red", "old", "hot", "ring", "bolt", "gear"], r.choice([0, 2, 3, 3])))
    kind = "brand string, listing_id string, source string, title string, location string, price double, last_seen_at timestamp_ntz"
    made = [(r.choice(["x", "y", None]), f"l{i}", r.choice(["olx", "facebook"]), title(), r.choice(["Itajaí, SC", "Campinas, SP", None]), r.choice([100.0, 101.0, 180.0, None]), START + timedelta(days=r.randrange(9))) for i in range(90)]
    return spark.createDataFrame([*made, ("z", "alone", "olx", "red ring", None, 1.0, START)], kind).cache()


def facts(side):
    return F.struct(*(F.col(f"{side}.{c}") for c in ("listing_id", "source", "price")), matching.tokens(F.col(f"{side}.title")).alias("title_tokens"), matching.tokens(F.col(f"{side}.location")).alias("place_tokens"))


@pytest.mark.parametrize("limit", [5, 250])
def test_unmatched_in_pool(rows, limit):
    pairs = pool_pairs(rows, ["brand"], limit)
    found = matching.matches(pairs.select(facts("target").alias("a"), facts("candidate").alias("b")))
    want = matching.exclude_matched(pairs, found).groupBy("target.listing_id").count()
    got = {tuple(r) for r in matching.unmatched_in_pool(rows, ["brand"], limit).collect()}
    assert got == {tuple(r) for r in want.collect()} and found.count() > 0


@pytest.mark.parametrize("limit", [5, 250])
def test_collapse_pools(rows, limit):
    want = matching.collapse_cross_posts(pool_pairs(rows, ["brand"], limit)).select("target_id", F.size("kept"), F.size("dropped"))
    got = {tuple(r) for r in matching.collapse_pools(rows, ["brand"], limit).collect()}
    assert got == {tuple(r) for r in want.collect()} and (limit == 5 or sum(r[2] for r in got) > 0)


def test_recent_matches_meet_by_title(rows):
    df = rows.withColumns({"category": F.col("brand"), "active": F.lit(True), "suppressed_at": F.lit(None).cast("timestamp_ntz")})
    made = [r.asDict() for r in matching.prepared(df.where("category is not null")).select("category", "m").collect()]
    pairs = df.sparkSession.createDataFrame([(x["m"], y["m"]) for x in made for y in made if x["category"] == y["category"]], f"a {dict(matching.prepared(df).dtypes)['m']}, b {dict(matching.prepared(df).dtypes)['m']}")
    out = matching.recent_matches(df, df, ["olx", "facebook"], START + timedelta(days=9))
    assert sorted(map(str, out.collect())) == sorted(map(str, matching.matches(pairs).collect()))
    assert "_a#" in out._jdf.queryExecution().optimizedPlan().toString()  # titles meet before listings do


def test_similar_titles(spark):
    r = random.Random(8)
    words = ["red", "old", "hot", "ring", "bolt", "gear", "blue", "7", "12", "big"]
    texts = {" ".join(r.choice(words) for _ in range(r.choice([1, 2, 3, 4, 5, 6, 6, 7, 9, 12]))) for _ in range(400)}
    sets = {t: set(t.split()) for t in texts}
    want = {(a, b) for a in texts for b in texts if a < b and len(sets[a] & sets[b]) * 20 >= 13 * len(sets[a] | sets[b])}
    got = [tuple(x) for x in matching.similar_titles(spark.createDataFrame([(t,) for t in texts], "title string")).collect()]
    assert set(got) == want and len(got) == len(want) > 500
    assert min(map(len, matching._choices(6, 13, 20))) >= 3  # three words meet at once, not one
