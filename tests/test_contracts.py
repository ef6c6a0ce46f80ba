"""Documents against their contracts."""

import json

from pyspark.sql import functions as F

from stallmark.operators import contracts as c

GOOD = {"gpuVendor": "AMD", "model": None, "normalizedModel": None, "boardBrand": "x", "vramGb": 8, "condition": "used", "usageTime": None, "warranty": None, "hasBox": None, "miningMentioned": False, "sellerClaimsNoMining": True, "defects": [], "repairsMentioned": False}
DEAL = {"score": 100, "verdict": "good", "advantages": [" a "], "risks": [], "reason": " r "}


def judged(spark, contract, *documents):
    df = spark.createDataFrame([(i, d if isinstance(d, str) or d is None else json.dumps(d)) for i, d in enumerate(documents)], "i int, doc string")
    good, bad = c.held_to(df, "doc", contract)
    return {r.i: (r.value, r.unknown_keys) for r in good.collect()}, {r.i: r.reasons for r in bad.collect()}


def test_gpu(spark):
    without = {k: v for k, v in GOOD.items() if k != "repairsMentioned"}
    good, bad = judged(spark, c.GPU, GOOD, GOOD | {"vramGb": 0}, GOOD | {"vramGb": "8"}, without, GOOD | {"gpuVendor": "Matrox", "condition": None}, GOOD | {"defects": ["a", None]}, GOOD | {"hasBox": "yes", "zeta": 1}, GOOD | {"zeta": 1, "alpha": {}, "vramGb": 0.5, "defects": ["a"]}, [GOOD], "{", None, "null")
    assert set(good) == {0, 7} and good[0][1] == [] and good[7][1] == ["alpha", "zeta"] and (good[7][0].vramGb, good[7][0].defects, good[0][0].gpuVendor) == (0.5, ["a"], "AMD")
    assert bad == {1: ["vramGb: not above 0"], 2: ["vramGb: not number"], 3: ["repairsMentioned: missing"], 4: ["gpuVendor: not one of NVIDIA, AMD, Intel", "condition: null"], 5: ["defects: not strings"], 6: ["hasBox: not boolean"], 8: ["not an object"], 9: ["not an object"], 10: ["not an object"], 11: ["not an object"]}


def test_vehicle_and_notebook(spark):
    car = dict.fromkeys(("brand", "model", "version", "year", "mileage")) | {"transmission": "cvt", "fuel": "flex", "condition": "new"} | dict.fromkeys(("maintenanceMentioned", "auctionMentioned", "sellerClaimsNoAuction", "accidentMentioned", "sellerClaimsNoAccident", "tradeAccepted", "financingAvailable"), True)
    good, bad = judged(spark, c.VEHICLE, car | {"year": 2000.0, "mileage": 0}, car | {"year": 1899}, car | {"year": 2000.5}, car | {"mileage": -1}, car | {"fuel": "coal"})
    assert good[0][0].year == 2000 and set(bad) == {1, 2, 3, 4} and bad[2] == ["year: not integer"]
    book = dict.fromkeys(("manufacturer", "model", "cpu", "cpuGeneration", "ramGb", "storageGb", "gpu", "screenInches", "resolution", "battery")) | {"storageType": "ssd", "condition": "used", "defects": []}
    good, bad = judged(spark, c.NOTEBOOK, book, book | {"ramGb": 0, "storageGb": 0}, book | {"condition": "refurbished"})
    assert set(good) == {0} and bad[1] == ["ramGb: not above 0", "storageGb: not above 0"] and c.contract_of("notebook") is c.NOTEBOOK and c.contract_of("chairs") is c.GENERIC


def test_model_answers(spark):
    good, bad = judged(spark, c.DEAL_ANALYSIS, DEAL, DEAL | {"score": 100.5}, DEAL | {"verdict": "great"}, DEAL | {"advantages": [" "]}, DEAL | {"risks": ["x"] * 11}, DEAL | {"risks": ["x" * 501], "reason": "  "}, DEAL | {"reason": "😀" * 1001}, DEAL | {"reason": "😀" * 1000})
    assert (good[0][0].advantages, good[0][0].reason) == (["a"], "r") and set(good) == {0, 7}
    assert bad == {1: ["score: more than 100"], 2: ["verdict: not one of bad, weak, fair, good, excellent_deal"], 3: ["advantages: holds less than 1"], 4: ["risks: more than 10 items"], 5: ["risks: holds more than 500", "reason: less than 1"], 6: ["reason: more than 2000"]}
    good, bad = judged(spark, c.EXTRACTED, {"data": {"a": 1}, "confidence": 1}, {"data": [], "confidence": -0.1})
    assert set(good) == {0} and bad[1] == ["data: not object", "confidence: less than 0"]


def test_stored_documents(spark):
    rows = [
        {"a": 1, "extractionConfidence": 0.7, "deterministicData": {"b": 2, "extractionModel": "m"}, "deterministicExtractionConfidence": "high", "extractionModel": "m", "extractionAttemptModel": 5, "extractionAttemptedAt": "2024-01-02T03:04:05", "sourceContentHash": "h"},
        {"a": 1, "deterministicData": {}, "extractionAttemptedAt": "never"},
        [1],
    ]
    df = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(rows)], "i int, doc string").select("i", c.stored_extraction(F.parse_json("doc")).alias("s")).orderBy("i")
    a, b, d = df.select(F.map_keys("s.enriched").alias("own"), F.map_keys("s.deterministic").alias("theirs"), "s.confidence", "s.deterministic_confidence", "s.model", "s.attempt_model", "s.content_hash", F.col("s.attempted_at").cast("string").alias("at")).collect()
    assert tuple(a) == (["a"], ["b"], 0.7, 0.7, "m", None, "h", "2024-01-02 03:04:05")
    assert tuple(b) == (["a"], ["a"], 0.5, 0.5, None, None, None, None) and tuple(d)[:4] == ([], [], 0.5, 0.5)
    again = c.analysis_of_record(spark.createDataFrame([(90, "bad")], "score int, verdict string")).first()
    assert again.verdict == "excellent_deal"
