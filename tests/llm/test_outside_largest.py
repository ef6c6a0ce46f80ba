"""Sizes outside the largest group of a shingle, against brute force and without a join of its groups."""

import random

from stallmark.llm.ngram_join import outside_largest


def test_outside_largest(spark):
    r = random.Random(3)
    rows = [(t, g, r.randint(5, 40), r.randint(41, 80), r.randint(1, 3)) for t in range(60) for g in r.sample(range(9), r.randint(1, 6))]
    out = outside_largest(spark.createDataFrame(rows, "token long, group long, lo int, hi int, often int"))
    want = {}
    for t in range(60):
        own = [x for x in rows if x[0] == t]
        if len(own) > 1:
            most = max(own, key=lambda x: (x[4], x[1]))
            rest = [x for x in own if x is not most]
            want[t] = (most[1], min(x[2] for x in own), max(x[3] for x in own), sum(x[4] for x in own), min(x[2] for x in rest), max(x[3] for x in rest))
    assert {x.token: (x.most, x.lo, x.hi, x.often, x.lo_, x.hi_) for x in out.collect()} == want
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
