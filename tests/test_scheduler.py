"""The schedule against a clock that looks every minute."""

import random

from stallmark.plans.stream import rocksdb
from stallmark.streaming.scheduler import MESSAGE, MINUTE, STARTS, Plan, schedule

KIND = f"search_id string, {MESSAGE}"


def by_the_clock(messages, end):
    """Every minute: messages so far, then whatever is due and not open."""
    plan, out, left = {"interval": None, "active": False, "last": None, "open": False}, [], sorted(messages)
    for tick in range(0, end + 1, MINUTE):
        while left and left[0][0] <= tick:
            at, _, kind, interval, active, last = left.pop(0)
            if kind == "define":
                plan["last"] = last if plan["interval"] is None else plan["last"]
                plan |= {"interval": interval * MINUTE, "active": active}
            elif plan["open"]:
                plan |= {"open": False, "last": at if kind == "complete" else plan["last"]}
        if plan["interval"] is not None and plan["active"] and not plan["open"] and (plan["last"] is None or plan["last"] + plan["interval"] <= tick):
            out.append(tick)
            plan["open"] = True
    return out


def some_messages(r, n=40, span=600):
    out = [(r.randrange(5 * MINUTE), 0, "define", r.choice([1, 15, 60]), True, r.choice([None, 0, -30 * MINUTE]))]
    for i in range(1, n):
        at = r.choice([r.randrange(span * MINUTE), r.randrange(span) * MINUTE])
        kind = r.choice(["complete", "complete", "fail", "define"])
        out.append((at, i, kind, r.choice([5, 30]) if kind == "define" else None, r.random() < 0.8 if kind == "define" else None, None))
    return out


def test_plan_equals_the_clock():
    r = random.Random(8)
    for _ in range(200):
        messages, end = some_messages(r), 700 * MINUTE
        assert Plan().run(sorted(messages), end) == by_the_clock(messages, end)
        plan, got, left = Plan(), [], sorted(messages)  # in steps, as a watermark moves
        for until in (97 * MINUTE + 5, 300 * MINUTE, end):
            got += plan.run([m for m in left if m[0] <= until], until)
            left = [m for m in left if m[0] > until]
        assert got == by_the_clock(messages, end)


def test_stream_equals_the_clock(spark, tmp_path):
    r = random.Random(3)
    every = {f"s{i}": some_messages(r) for i in range(4)}
    steps = [[], [], [("", 720 * MINUTE, -1, "define", 1, False, None)]]
    for name, messages in every.items():
        for m in messages:
            steps[min(2, (m[0] + r.randrange(20 * MINUTE)) // (250 * MINUTE))].append((name, *m))
    with rocksdb(spark):
        for step in steps:
            spark.createDataFrame(step, KIND).write.mode("append").parquet(str(tmp_path / "in"))
            out = schedule(spark.readStream.schema(KIND).parquet(str(tmp_path / "in")), "20 minutes")
            out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    got = sorted(map(tuple, spark.read.schema(STARTS).parquet(str(tmp_path / "out")).collect()))
    assert got == sorted((name, t) for name, messages in every.items() for t in by_the_clock(messages, 700 * MINUTE))
