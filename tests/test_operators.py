"""Table operators on small tables."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stallmark.analyzers.vehicle import VehicleAnalyzer
from stallmark.operators import comparables, dedup, matching, reports, state, statistics, validation
from stallmark.schema import LISTING, NOTIFICATION, SEARCH, SUMMARY
from stallmark.sources import parsers
from stallmark.sources.registry import Criteria, ProviderRegistry, paged_items

NOW = datetime(2024, 5, 1, 12)


def summary(seq, external_id="1", url="https://www.olx.com.br/item/a-1234567", title="Placa RTX 3060", price=1300.0, source="olx", **more):
    return (seq, source, external_id, title, price, more.get("currency", "BRL"), more.get("location", "Itajaí, SC"), url, None)


def summaries(spark, *rows):
    return spark.createDataFrame(rows, SUMMARY)


def test_statistics(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (0, 10, 20, 30)] + [("b", float("nan")), ("b", -1.0), ("b", None)], "k string, price double")
    got = {r.k: r for r in statistics.price_statistics(df, ["k"]).collect()}
    assert (got["a"].p25, got["a"].median_price, got["a"].confidence) == (7.5, 15.0, "low") and got["b"].sample_size == 0 and got["b"].mean_price is None
    ten = spark.createDataFrame([("t", "olx", 1500.0 + 10 * i) for i in range(10)] + [("t", "facebook", 1.0)], "k string, source string, price double")
    maps = statistics.market_maps(ten, ["k"]).first()
    assert maps.combined.sample_size == 11 and maps.by_source["olx"].median_price == 1545.0 and maps.by_source["olx"].confidence == "high"
    with pytest.raises(ValueError):
        statistics.percentile("price", 101)


def test_first_wins_and_keys_stay_apart(spark):
    rows = [summary(1), summary(2, title="later"), summary(3, None, "https://olx.com.br/item/a-1234567/?utm_source=x"), summary(4, None, "https://www.olx.com.br/item/a-1234567"), summary(5, source="facebook")]
    got = dedup.deduplicate_listings(summaries(spark, *rows))
    assert sorted(r.seq for r in got.collect()) == [1, 3, 5]
    again = dedup.deduplicate_listings(got.drop("dedup_key"))
    assert again.count() == got.count()


def test_gate(spark):
    rows = [summary(1), summary(2, source="facebook"), summary(3, url="https://evil.com/x"), summary(4, title=" "), summary(5, price=-1.0), summary(6, currency="brl"), summary(7, currency="R$")]
    good, bad = validation.gate(summaries(spark, *rows), F.lit("olx"))
    assert [(r.seq, r.currency) for r in good.orderBy("seq").collect()] == [(1, "BRL"), (6, "BRL")]
    assert {r.seq: r.reasons for r in bad.collect()} == {2: ["provider", "host"], 3: ["host"], 4: ["title"], 5: ["price"], 7: ["currency"]}


def search(**over):
    row = {"search_id": "s", "name": "n", "query": "q", "category": "gpu", "providers": ["olx"], "minimum_score": 70, "interval_minutes": 60, "forbidden_words": [], "active": True} | over
    return tuple(row.get(f) for f in SEARCH.fieldNames())


def test_search_definitions(spark):
    bad = [{"min_price": 2.0, "max_price": 1.0}, {"min_year": 2001, "max_year": 2000}, {"radius_km": 5}, {"providers": []}, {"category": "boats"}, {"minimum_score": 101}, {"forbidden_words": [" "]}, {"name": None}]
    df = spark.createDataFrame([search(), *(search(search_id=str(i), **b) for i, b in enumerate(bad))], SEARCH)
    got = {r.search_id: r.why for r in df.select("search_id", validation.search_reasons().alias("why")).collect()}
    assert got.pop("s") == [] and [got[str(i)] for i in range(8)] == [["min_price"], ["min_year"], ["radius_km"], ["providers"], ["category"], ["minimum_score"], ["forbidden_words"], ["name"]]
    legacy = spark.createDataFrame([search(name=" ", min_price=9.0, max_price=3.0, min_year=1, minimum_score=500, forbidden_words=["b", " a ", "a", ""], radius_km=9)], SEARCH)
    r = validation.clean_legacy_searches(legacy).first()
    assert (r.name, r.min_price, r.max_price, r.min_year, r.minimum_score, r.forbidden_words, r.radius_km) == ("s", 3.0, 9.0, None, 100, ["a", "b"], None)


def test_numbers_and_details(spark):
    df = spark.createDataFrame([("",), ("4.5",), ("x",), ("inf",), (None,)], "t string")
    assert [(r.x.value, r.x.error) for r in df.select(validation.number_or_error(F.col("t")).alias("x")).collect()] == [(None, False), (4.5, False), (None, True), (None, True), (None, False)]
    s = summaries(spark, summary(1), summary(2, None))
    d = summaries(spark, summary(1, "2"), summary(2, "9"))
    assert [r.seq for r in validation.matching_details(s, d).collect()] == [2]
    j = spark.createDataFrame([('{"brand":"x","more":1}',), ("{",)], "j string")
    assert [r.x for r in j.select(validation.category_data(F.col("j"), "brand string")["brand"].alias("x")).collect()] == ["x", None]


def test_vehicles_compare_from_the_target(spark):
    schema = "listing_id string, category string, currency string, price double, last_seen_at timestamp_ntz, data struct<brand:string,model:string,year:int,mileage:long,condition:string>"
    row = lambda i, km, year=2015, cond="used", cur="BRL": (i, "vehicle", cur, 1.0, NOW - timedelta(hours=int(i)), ("vw", "golf", year, km, cond))
    df = spark.createDataFrame([row("1", 200_000), row("2", 135_000), row("3", None, 2018), row("4", 200_000, 2016, "damaged"), row("5", 200_000, cur=None)], schema)
    pairs = lambda n: {(r.a, r.b) for r in comparables.comparable_pairs(df, df, VehicleAnalyzer(), n).select("target.listing_id", "candidate.listing_id").toDF("a", "b").collect()}
    assert pairs(250) == {("1", "2"), ("4", "1"), ("4", "2"), ("4", "3")}  # 2 does not see 1: the distance counts from the target
    assert pairs(1) == {("1", "2"), ("4", "1")}  # the limit comes before the predicate, and one's own row does not count


def listings(spark, *rows):
    return spark.createDataFrame([(i, s, "gpu", t, p, loc, True, None, NOW) for i, s, t, p, loc in rows], "listing_id string, source string, category string, title string, price double, location string, active boolean, suppressed_at timestamp_ntz, last_seen_at timestamp_ntz")


def test_matches(spark):
    df = listings(spark, ("a", "olx", "Placa RTX 3060 Galax", 1500.0, "Itajaí, SC"), ("b", "facebook", "RTX 3060 Galax placa", 1510.0, None), ("c", "olx", "Placa RTX 3060 Galax", 1500.0, "Itajaí, SC"), ("d", "facebook", "Mesa", 1500.0, "Itajaí, SC"), ("e", "facebook", "placa rtx 3060 galax oc", 0.0, "Itajaí, SC"))
    got = {(r.a, r.b): (round(r.confidence, 6), r.reasons) for r in matching.recent_matches(df, df, ["olx", "facebook"], NOW).collect()}
    assert got[("a", "b")] == got[("b", "a")] == (0.8, ["Títulos semelhantes (100%)", "Preços iguais ou muito próximos"])
    assert set(got) == {("a", "b"), ("b", "a"), ("c", "b"), ("b", "c")}
    assert {(r.a, r.b) for r in matching.all_matches(df).collect()} == {("a", "b"), ("b", "c")}
    saved = matching.save_matches(df.select(F.lit("a").alias("a"), F.lit("b").alias("b"), F.lit(0.1).alias("confidence"), F.array(F.lit("old")).alias("reasons")).limit(1), matching.all_matches(df), df)
    assert {(r.a, r.b): round(r.confidence, 3) for r in saved.collect()} == {("a", "b"): 0.8, ("b", "c"): 0.8}


def test_greedy_collapse_keeps_the_first(spark):
    df = listings(spark, ("t", "olx", "x", 1.0, None), ("a", "olx", "Placa RTX 3060 Galax", 100.0, "Itajaí, SC"), ("b", "facebook", "Placa RTX 3060 Galax", 101.0, "Itajaí, SC"), ("c", "mercadolivre", "Placa RTX 3060 Galax", 104.0, None))
    c = F.struct("listing_id", "source", "title", "location", "price", F.ascii("listing_id").alias("pool_rank"))
    rows = df.select(c.alias("candidate")).where("candidate.listing_id <> 't'").crossJoin(df.where("listing_id = 't'").select(F.struct("listing_id").alias("target")))
    r = matching.collapse_cross_posts(rows).first()
    assert [k.listing_id for k in r.kept] == ["a", "c"] and [(d.a, d.b) for d in r.dropped] == [("a", "b")]  # c matches only b, which is gone


def stored(spark, *rows):
    names = LISTING.fieldNames()
    base = {"category": "gpu", "images": ["i"], "attributes": {"k": "v"}, "first_seen_at": NOW - timedelta(days=9), "last_seen_at": NOW - timedelta(days=9), "last_checked_at": NOW - timedelta(days=9), "active": True, "description": "d", "content_hash": "h", "source": "olx", "currency": "BRL", "location": "Itajaí, SC"}
    return spark.createDataFrame([tuple((base | r).get(n) for n in names) for r in rows], LISTING)


def test_upsert(spark):
    url = "https://olx.com.br/item/a-1234567"
    old = stored(
        spark,
        {"listing_id": "same", "external_id": "1", "title": "Placa RTX 3060", "price": 1300.0, "url": url, "normalized_url": url},
        {"listing_id": "cheaper", "external_id": "2", "title": "Placa RTX 3060", "price": 1400.0, "url": url, "normalized_url": url},
        {"listing_id": "gone", "external_id": None, "title": "[removido]", "url": "https://olx.com.br/item/g-1", "normalized_url": "https://olx.com.br/item/g-1", "suppressed_at": NOW},
        {"listing_id": "unseen", "external_id": "8", "title": "x", "price": None, "url": url, "normalized_url": url},
    )
    batch = summaries(spark, summary(1, "1"), summary(2, "2"), summary(3, "3", "https://www.olx.com.br/item/g-1/"), summary(4, "4"), summary(5, "4", title="repeat")).withColumn("category", F.lit("gpu"))
    got = {r.listing_id: r for r in state.upsert_summaries(old, batch, NOW).collect()}
    assert {k: (r.change, r.price_point) for k, r in got.items()} == {"same": ("same", None), "cheaper": ("changed", 1300.0), "gone": ("suppressed", None), "unseen": (None, None), "olx:id:4": ("new", 1300.0)}
    assert got["same"].description == "d" and got["cheaper"].description is None and got["cheaper"].content_hash is None and got["same"].last_seen_at == NOW
    assert got["gone"].external_id == "3" and got["gone"].title == "[removido]" and got["unseen"].last_seen_at < NOW and got["olx:id:4"].title == "Placa RTX 3060"
    tomb = {r.listing_id: r for r in state.suppress(old, old.where("listing_id = 'same'"), NOW).collect()}
    assert tomb["same"].title == "[removido]" and tomb["same"].external_id == "1" and not tomb["same"].active and tomb["cheaper"].active
    details = old.where("listing_id = 'same'").select("listing_id", "title", F.lit("new text").alias("description"), "price", "currency", "location", "seller_name", "url", "image_url", "images", "attributes", "published_at")
    after = {r.listing_id: r for r in state.update_details(old, details, NOW).collect()}
    assert after["same"].description == "new text" and after["same"].content_hash != "h" and after["cheaper"].content_hash == "h"


def test_price_changes_and_fences(spark):
    obs = spark.createDataFrame([("a", i, NOW + timedelta(hours=i), p) for i, p in enumerate([100.0, None, 100.0, 100.0, 90.0, None])], "listing_id string, seq int, observed_at timestamp_ntz, price double")
    points = state.price_changes(obs)
    assert [r.seq for r in points.orderBy("seq").collect()] == [0, 2, 4]
    assert [p.price for p in state.price_history(points, last=2).first().history] == [100.0, 90.0]
    live = spark.createDataFrame([("a", NOW, "f", None, None), ("b", NOW, "f", "c", NOW)], "listing_id string, updated_at timestamp_ntz, fingerprint string, content_hash string, suppressed_at timestamp_ntz")
    fence = F.struct(F.lit(NOW).alias("updated_at"), F.lit("f").alias("fingerprint"), F.lit(None).cast("string").alias("content_hash"))
    updates = spark.createDataFrame([("a",), ("b",), ("c",)], "listing_id string").withColumn("fence", fence)
    ok, stale = state.apply_fenced(live, updates)
    assert [r.listing_id for r in ok.collect()] == ["a"] and sorted(r.listing_id for r in stale.collect()) == ["b", "c"]


def test_notifications(spark):
    row = lambda i, status, minutes=None, n=0: (str(i), "l", "s", str(i), "telegram", status, n, NOW - timedelta(minutes=minutes) if minutes is not None else None, None, None)
    df = spark.createDataFrame([row(1, "pending"), row(2, "failed", n=1), row(3, "sending", 20, 2), row(4, "sending", 5, 1), row(5, "sent")], NOTIFICATION)
    got = state.claim(df, NOW)
    assert {r.notification_id: (r.claimed, r.status, r.attempts) for r in got.collect()} == {"1": (True, "sending", 1), "2": (True, "sending", 2), "3": (True, "sending", 3), "4": (False, "sending", 1), "5": (False, "sent", 0)}
    outcomes = spark.createDataFrame([("1", NOW, 1, True, None), ("2", NOW, 2, False, "x" * 3000), ("3", NOW, 2, True, None)], "notification_id string, claimed_at timestamp_ntz, attempts int, ok boolean, error string")
    from stallmark.functions.text import error_message

    after = {r.notification_id: r for r in state.settle(got.drop("claimed"), outcomes, error_message(F.col("error")), NOW).collect()}
    assert after["1"].status == "sent" and after["1"].sent_at == NOW and after["2"].status == "failed" and len(after["2"].last_error) == 2000
    assert after["3"].status == "sending"  # an older claim of it
    with pytest.raises(ValueError):
        state.claim(df, NOW, 0)


def test_analyses_and_leases(spark):
    kind = "analysis_id string, listing_id string, search_id string, input_hash string, score int, analysis_model string, llm_attempted_at timestamp_ntz, created_at timestamp_ntz"
    old = spark.createDataFrame([("1", "l", "s", "h", 50, None, None, NOW), ("2", "m", "s", "h", 50, None, None, NOW)], kind)
    new = spark.createDataFrame([("9", "l", "s", "h", 60, "m", NOW, NOW), ("8", "m", "s", "h", 70, None, NOW, NOW), ("7", "n", "s", "h", 10, None, None, NOW)], kind)
    got = {r.listing_id: (r.analysis_id, r.score, r.llm_attempted_at) for r in state.save_analyses(old, new).collect()}
    assert got == {"l": ("1", 60, NOW), "m": ("2", 50, NOW), "n": ("7", 10, None)}
    s = spark.createDataFrame([search(), search(search_id="held", run_lease_id="other", run_lease_expires_at=NOW + timedelta(minutes=1)), search(search_id="late", run_lease_id="other", run_lease_expires_at=NOW)], SEARCH)
    taken = state.lease(s, s, "mine", NOW)
    assert {r.search_id: r.run_lease_id for r in taken.collect()} == {"s": "mine", "held": "other", "late": "mine"}
    done = {r.search_id: (r.run_lease_id, r.last_run_at) for r in state.release(taken, "mine", NOW, True).collect()}
    assert done == {"s": (None, NOW), "held": ("other", None), "late": (None, NOW)}
    checks = validation.table_checks(s, old.select("score", F.lit(95).alias("deterministic_score"), F.lit("good").alias("verdict")), spark.createDataFrame([("b", "a", 0.5)], "a string, b string, confidence double"), spark.createDataFrame([], NOTIFICATION))
    assert {r.rule: r.broken for r in checks.collect()} == {"search_definition": 0, "search_lease": 0, "analysis_score": 2, "analysis_verdict": 0, "match_pair": 1, "notification_status": 0}


def test_extractions_are_kept(spark):
    kind = "listing_id string, category string, data string, model string, attempt_model string, attempted_at timestamp_ntz, content_hash string"
    old = spark.createDataFrame([("a", "gpu", "good", "m", "m", NOW, "h"), ("b", "gpu", "good", "m", "m", NOW, "h")], kind)
    new = spark.createDataFrame([("a", "gpu", "bare", None, "m2", NOW + timedelta(1), "h"), ("b", "gpu", "bare", None, "m2", NOW, "other"), ("c", "gpu", "x", None, None, None, "h")], kind)
    got = {r.listing_id: (r.data, r.model, r.attempt_model) for r in state.save_extractions(old, new).collect()}
    assert got == {"a": ("good", "m", "m2"), "b": ("bare", None, "m2"), "c": ("x", None, None)}
    own = F.struct(F.lit("unknown").alias("fuel"), F.lit(2010).alias("year"), F.array(F.lit("a")).alias("defects"))
    more = F.struct(F.lit("flex").alias("fuel"), F.lit(2011).alias("year"), F.array(F.lit("b"), F.lit("a")).alias("defects"))
    m = spark.range(1).select(state.merge_supplement(own, more, {"fuel": "string", "year": "int", "defects": "array<string>"}).alias("m")).first().m
    assert (m.fuel, m.year, m.defects) == ("flex", 2010, ["a", "b"])


def test_cards(spark):
    f = spark.createDataFrame([("https://www.facebook.com/marketplace/item/99/", "R$ 1.500\nPlaca RTX\nItajaí, SC", None, "https://i/1.jpg"), ("https://www.facebook.com/x", "R$ 1", None, None)], "href string, text string, aria_label string, image string")
    r = parsers.facebook_cards(f).collect()
    assert len(r) == 1 and (r[0].external_id, r[0].title, r[0].price, r[0].location, r[0].currency) == ("99", "Placa RTX", 1500.0, "Itajaí, SC", "BRL")
    o = spark.createDataFrame([("https://sc.olx.com.br/x-1234567", None, "Placa RTX\nR$ 1.299,90\nItajaí SC", "data:x")], "href string, title string, text string, image string")
    r = parsers.olx_cards(o).first()
    assert (r.external_id, r.title, r.price, r.location, r.image_url) == ("1234567", "Placa RTX", 1299.9, "Itajaí SC", None)
    m = spark.createDataFrame([("https://produto.mercadolivre.com.br/MLB-12345678-x", " Placa ", "1.500", None, None), ("https://x.com/none", "Placa", "1", None, None)], "href string, title string, price_text string, image string, location string")
    assert [(r.external_id, r.title, r.price) for r in parsers.mercadolivre_cards(m).collect()] == [("MLB12345678", "Placa", 1500.0)]


def test_details(spark):
    s = summaries(spark, summary(1))
    d = spark.createDataFrame([(1, "Nova placa | Facebook", " text ", "R$ 900", None, "Ana", ["http://a", "http://a", "x"], {"k": "v"}, "2024-13-01")], "seq long, title string, description string, price_text string, location string, seller_name string, images array<string>, attributes map<string,string>, published_at string")
    r = parsers.merge_details(s, d, title=parsers.usable_title).first()
    assert (r.title, r.price, r.location, r.images, r.image_url, r.published_at, r.attributes) == ("Nova placa", 900.0, "Itajaí, SC", ["http://a"], "http://a", None, {"k": "v"})
    page = "Marketplace\nR$ 1.200\nItajaí, SC\nCondição\nUsado\nDescrição do vendedor\nlinha 1\nlinha 2\nInformações do vendedor\nAna"
    p = spark.createDataFrame([(page,)], "t string").select(parsers.facebook_page(F.col("t")).alias("p")).first().p
    assert p.price_text == "R$ 1.200" and p.seller_name == "Ana" and p.attributes == {"Condição": "Usado"} and p.description.startswith("linha 1\nlinha 2")
    html = '<script type="application/ld+json">{"@graph":[{"@type":"Thing"},{"@type":"Product","name":"Placa"}]}</script><script type="application/ld+json">{bad</script>'
    v = spark.createDataFrame([(html,)], "h string").select(F.try_variant_get(parsers.json_ld_product(F.col("h")), "$.name", "string").alias("n")).first()
    assert v.n == "Placa"
    a = spark.createDataFrame([(["Marca: Galax", "x", "Marca: Asus", "Cor : preta"],)], "l array<string>").select(parsers.listed_attributes(F.col("l")).alias("a")).first().a
    assert a == {"Marca": "Asus", "Cor": "preta"}


def test_api(spark):
    body = '{"results":[{"id":"MLB1","title":"A","price":1.5}],"paging":{"total":120}}'
    pages = spark.createDataFrame([(0, body), (50, body.replace("MLB1", "MLB2")), (100, '{"results":[],"paging":{"total":120}}'), (150, body)], "offset int, body string")
    assert [(r.seq, r.id) for r in paged_items(pages, "struct<id:string,title:string,price:double>").orderBy("seq").collect()] == [(0, "MLB1"), (50, "MLB2")]
    items = spark.createDataFrame([("MLB1", "A", 1.0, "BRL", "https://x", None, ("Itajaí", None), None)], "id string, title string, price double, currency_id string, permalink string, thumbnail string, address struct<city_name:string,state_name:string>, z string")
    assert parsers.api_items(items).first().location == "Itajaí"
    detail = spark.createDataFrame([("MLB1", "A", 1.0, "BRL", "https://x", None, (("Itajaí",), ("SC",)), [("http://a", "https://b")], [("RAM", None, "8"), ("RAM", "16", None)], "2024-01-01T00:00:00Z")], "id string, title string, price double, currency_id string, permalink string, thumbnail string, seller_address struct<city:struct<name:string>,state:struct<name:string>>, pictures array<struct<url:string,secure_url:string>>, attributes array<struct<name:string,value_name:string,value_id:string>>, date_created string")
    r = parsers.api_details(detail, spark.createDataFrame([("MLB1", None, "txt")], "id string, plain_text string, text string")).first()
    assert (r.location, r.images, r.image_url, r.attributes, r.description) == ("Itajaí, SC", ["https://b"], "https://b", {"RAM": "16"}, "txt")


def test_providers(spark):
    registry = ProviderRegistry()
    registry.register("mercadolivre", lambda s, c: summaries(s, *(summary(i, "1", price=p, source="mercadolivre", url="https://www.mercadolivre.com.br/x") for i, p in ((1, 10.0), (2, 100.0)))), filter_prices=True)
    assert registry.search(spark, "mercadolivre", Criteria("rtx", 50.0, 1000.0))[0].count() == 0  # the first arrival decides
    registry.register("olx", lambda s, c: summaries(s, summary(2, "2", price=None), summary(1, "1", price=50.0), summary(3, "3", price=5000.0), summary(4, "2")))
    good, bad = registry.search(spark, "olx", Criteria("rtx", max_price=1000.0, limit=2))
    assert [r.seq for r in good.collect()] == [1, 2] and bad.count() == 0 and registry.list() == ["mercadolivre", "olx"] and registry.has("olx")
    for wrong in (lambda: registry.register("olx", None), lambda: Criteria("x", limit=201)):
        with pytest.raises(ValueError):
            wrong()
    with pytest.raises(KeyError):
        registry.get("other")


def test_reports(spark):
    rows = stored(spark, {"listing_id": "a", "title": "A", "url": "u"}, {"listing_id": "b", "title": "B", "url": "u", "suppressed_at": NOW})
    a = spark.createDataFrame([("1", "a", 50, "fair", NOW), ("2", "a", 80, "good", NOW + timedelta(1))], "analysis_id string, listing_id string, score int, verdict string, created_at timestamp_ntz")
    assert [(r.listing_id, r.score) for r in reports.recent_listings(rows, a).collect()] == [("a", 80)]
    with pytest.raises(ValueError):
        reports.recent_listings(rows, a, 500)
