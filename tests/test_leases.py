"""Calls on leases against a serial replay."""

import random
from datetime import datetime, timedelta

from stallmark.operators.leases import Lease, replay

START = datetime(2024, 1, 1)


def test_rules():
    x = Lease(True, None, None, None, 100)
    assert [x.call("acquire", 0, "a", None), x.call("acquire", 50, "b", None), x.call("acquire", 50, "a", None)] == ["granted", "refused", "refused"]
    assert x.call("renew", 60, "b", None) == "lost" and x.call("renew", 60, "a", None) == "renewed" and x.expires == 160
    assert x.call("acquire", 159, "b", None) == "refused" and x.call("acquire", 160, "b", None) == "granted" and x.fence == 2
    assert x.call("renew", 161, "a", None) == "lost" and x.call("complete", 161, "a", None) == "missed"
    assert x.call("renew", 900, "b", None) == "renewed"  # long past its end, but nobody took it
    assert x.call("complete", 901, "b", None) == "released" and (x.holder, x.expires, x.last_run) == (None, None, 901)
    assert x.call("acquire", 902, "c", None) == "refused" and x.call("acquire", 902, "c", 901) == "granted" and x.call("fail", 903, "c", None) == "released" and x.last_run == 901
    assert x.call("acquire", 904, "d", 5, fresh=True) == "granted" and x.call("other", 905, "d", None) == "missed"
    assert Lease(False, None, None, None, 100).call("acquire", 0, "a", None) == "refused"


def test_replay_of_shuffled_calls(spark):
    r = random.Random(2)
    calls = [(r.choice("pqqqq"), i, START + timedelta(minutes=r.randrange(300)), r.choice(["acquire", "acquire", "renew", "complete", "fail"]), r.choice("abc"), None, r.random() < 0.9) for i in range(600)]
    searches = spark.createDataFrame([("p", True, None, None, None), ("q", True, "b", START + timedelta(minutes=10), START), ("r", True, None, None, None)], "search_id string, active boolean, run_lease_id string, run_lease_expires_at timestamp_ntz, last_run_at timestamp_ntz")
    df = spark.createDataFrame([*calls, ("unknown", 9999, START, "acquire", "a", None, True)], "search_id string, seq long, at timestamp_ntz, kind string, lease_id string, seen_last_run_at timestamp_ntz, fresh boolean").repartition(7)
    micros = lambda t: int((t - START).total_seconds()) * 1_000_000
    states = {"p": Lease(True, None, None, None, 30 * 60_000_000), "q": Lease(True, "b", micros(START + timedelta(minutes=10)), 0, 30 * 60_000_000)}
    want = {}
    for s, seq, at, kind, who, _, fresh in sorted(calls, key=lambda c: (c[0], c[2], c[1])):
        want[seq] = (states[s].call(kind, micros(at), who, None, fresh), states[s].fence, states[s].holder)
    assert {x.seq: (x.outcome, x.fence, x.holder) for x in replay(searches, df).collect()} == want
