"""Price series whose rows arrive late."""

import random

from stallmark.plans.stream import rocksdb
from stallmark.streaming.ordered import CHANGE, ordered_price_changes

KIND = "listing_id string, seq long, micros long, price double"
SECOND = 1_000_000


def changes(rows, idle=None):
    out, last = [], {}
    for key, seq, at, price in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        before, since = last.get(key, (None, None))
        if idle and since is not None and at - since >= idle:
            before = None
        if price is not None and price != before:
            out.append((key, seq, at, price))
        last[key] = (price, at)
    return sorted(out)


def run(spark, where, steps, delay, idle_ms=None):
    total = None
    with rocksdb(spark):
        for step in steps:
            spark.createDataFrame(step, KIND).write.mode("append").parquet(f"{where}/in")
            stream = ordered_price_changes(spark.readStream.schema(KIND).parquet(f"{where}/in"), delay, idle_ms)
            query = stream.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/check").trigger(availableNow=True).start()
            query.awaitTermination()
            total = query.lastProgress.stateOperators[0].numRowsTotal
    return sorted(map(tuple, spark.read.schema(CHANGE).parquet(f"{where}/out").collect())), total


def test_shuffled_rows_give_the_batch_result(spark, tmp_path):
    r = random.Random(6)
    rows = [(f"l{i % 5}", i, r.randrange(100) * SECOND + r.choice([0, 1, 999_999]), r.choice([1.0, 2.0, None])) for i in range(300)]
    steps = [[], [], []]
    for x in rows:
        steps[min(2, (x[2] + r.randrange(20 * SECOND)) // (40 * SECOND))].append(x)
    late = ("l1", 999, 5 * SECOND, 77.0)  # sixty seconds behind: never seen
    end = ("", -1, 1000 * SECOND, None)
    got, held = run(spark, tmp_path, [steps[0], steps[1], [*steps[2], late], [end]], "21 seconds")
    assert got == changes(rows)
    assert held < 40  # the last price of five series, one waiting row, counters and timers: no waiting rows


def test_silent_series_begin_anew(spark, tmp_path):
    rows = [("a", 1, 1 * SECOND, 5.0), ("a", 2, 3 * SECOND, 5.0), ("a", 3, 60 * SECOND, 5.0), ("b", 4, 2 * SECOND, 7.0), ("b", 5, 9 * SECOND, 7.0)]
    got, _ = run(spark, tmp_path, [rows[:2] + rows[3:], rows[2:3], [("", -1, 500 * SECOND, None)]], "5 seconds", idle_ms=30_000)
    assert got == changes(rows, 30 * SECOND) == [("a", 1, 1 * SECOND, 5.0), ("a", 3, 60 * SECOND, 5.0), ("b", 4, 2 * SECOND, 7.0)]
