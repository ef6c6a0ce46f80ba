"""Similar titles: pairs are judged where titles meet, and each is given once, against every pair."""

import random

from stallmark.operators import matching


def test_pairs_are_neither_shuffled_nor_made_distinct(spark):
    r = random.Random(4)
    texts = {" ".join([r.choice(["red", "large"]), r.choice(["ring", "bolt"]), r.choice(["LARGE", "PROMO"]), f"Brand#{r.randrange(6)}", str(r.randrange(6)), *r.sample(["a", "b", "c", "d"], r.choice([0, 0, 1, 4]))]) for _ in range(300)}
    sets = {t: set(t.lower().replace("#", " ").split()) for t in texts}
    want = sorted((a, b) for a in texts for b in texts if a < b and len(sets[a] & sets[b]) * 20 >= 13 * len(sets[a] | sets[b]))
    out = matching.similar_titles(spark.createDataFrame([(t,) for t in texts], "title string"))
    assert sorted(map(tuple, out.collect())) == want and len({len(s) for s in sets.values()}) > 4
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Join Inner") == 3  # two of them with the few broadcast choices


def test_choices_hold_for_each_pair_of_sizes():
    """Of two titles that share as few words as they may, the first shared ones are a choice of both."""
    r = random.Random(5)
    for n in range(1, 15):
        for m in range(1, n + 1):
            must = next((k for k in range(m + 1) if k * 20 >= 13 * (n + m - k)), None)
            mine, other = ({tuple(c) for c in matching._choices(*x)} for x in ((n, 13, 20, m), (m, 13, 20, n)))
            assert bool(mine) == bool(other) == (must is not None)
            for _ in range(30 if mine else 0):
                places = r.sample(range(n + m - must), n + m - must)
                common, rest = places[:must], places[must:]
                a, b = sorted([*common, *rest[: n - must]]), sorted([*common, *rest[n - must :]])
                k = len(next(iter(mine)))
                assert tuple(a.index(x) for x in sorted(common)[:k]) in mine and tuple(b.index(x) for x in sorted(common)[:k]) in other
