"""Scalar functions and extractions against known values."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from stallmark.analyzers import Listing, default_registry, detect_category
from stallmark.analyzers.generic import GenericAnalyzer
from stallmark.analyzers.gpu import GpuAnalyzer, gpu_model
from stallmark.analyzers.notebook import NotebookAnalyzer
from stallmark.analyzers.vehicle import VehicleAnalyzer
from stallmark.functions import hashing, numbers, text, urls
from stallmark.operators import filters, scoring


def one(spark, column, **values):
    """column over one row of string (or typed) literals."""
    df = spark.range(1)
    for name, v in values.items():
        df = df.withColumn(name, v if not isinstance(v, (str, type(None))) else F.lit(v).cast("string"))
    return df.select(column.alias("x")).first().x


def column_of(spark, fn, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in rows.select("i", fn(F.col("t")).alias("x")).orderBy("i").collect()]


def test_prices(spark):
    texts = ["R$ 1.500,00", "R$ 75.000", "1299.90", "Consulte", None, "", "-5", "1,2,3", "R$ 2.000", "1.234.567", "12.34.56", "0"]
    assert column_of(spark, numbers.parse_price, texts) == [1500.0, 75000.0, 1299.9, None, None, None, None, None, 2000.0, 1234567.0, None, 0.0]


def test_titles(spark):
    texts = ["GALAX — RTX 3060 Ti, 8GB!", "Ação e Órgão", "Kelvin İstanbul", None, "  ", "ß ø đ"]
    assert column_of(spark, text.normalize_title, texts) == ["galax rtx 3060 ti 8gb", "acao e orgao", "kelvin istanbul", None, "", ""]
    assert column_of(spark, text.nullable_text, [" a   b ", " ", None]) == ["a b", None, None]


def test_titles_agree_with_the_rule_over_the_plane(spark):
    import re
    import unicodedata

    chars = [chr(c) for c in range(32, 0x3100) if not 0xD800 <= c < 0xE000]
    model = lambda s: re.sub("[^a-z0-9]+", " ", re.sub("[̀-ͯ]", "", unicodedata.normalize("NFD", s)).lower()).strip()
    assert column_of(spark, text.normalize_title, chars) == [model(c) for c in chars]


def test_urls(spark):
    texts = ["https://www.Example.com/item/1/?utm_source=x&variant=2#top", "http://a.com", "https://a.com/?b=2&a=1&b=1", "nothing", None, "https://a.com:443/x//", "https://a.com:8080/x?q"]
    assert column_of(spark, urls.normalize_url, texts) == ["https://example.com/item/1?variant=2", "http://a.com/", "https://a.com/?a=1&b=2&b=1", None, None, "https://a.com/x", "https://a.com:8080/x?q="]
    assert column_of(spark, urls.is_http_url, ["https://a.com", "ftp://a.com", "x", None]) == [True, False, False, False]
    own = lambda u: urls.is_marketplace_url(F.lit("olx"), u)
    assert column_of(spark, own, ["https://sc.olx.com.br/x", "https://olx.com.br.evil.com/", "http://olx.com.br/", "https://u@olx.com.br/", "https://notolx.com.br/"]) == [True, False, False, False, False]
    ids = [("facebook", "https://facebook.com/marketplace/item/123/?x"), ("olx", "https://olx.com.br/item/abc-1234567"), ("mercadolivre", "https://x.com/p?pdp_filters=item_id%3AMLB-12345678"), ("mercadolivre", "https://x.com/MLB-7654321-abc"), ("olx", "https://olx.com.br/item/abc-12")]
    df = spark.createDataFrame(ids, "s string, u string")
    assert [r.x for r in df.select(urls.first_party_id(F.col("s"), F.col("u")).alias("x")).collect()] == ["123", "1234567", "MLB12345678", "MLB7654321", None]


def test_mileage(spark):
    assert column_of(spark, numbers.parse_mileage, ["92.000 km", "92 mil km", "120k km", "1.234,5", None, "km", "92,5 mil"]) == [92000, 92000, 120000, 1235, None, None, 92500]


def test_places(spark):
    texts = ["Itajaí, SC", "Curitiba - pr", "Joinville Santa Catarina", "Belém Pará", "Nowhere", "São Paulo, São Paulo"]
    assert column_of(spark, text.state_of, texts) == ["SC", "PR", "SC", "PA", None, "SP"]
    assert column_of(spark, text.city_of, texts[:4]) == ["itajai", "curitiba", "joinville", "belem"]


def test_similarity_and_signature(spark):
    assert one(spark, text.token_similarity(F.col("a"), F.col("b")), a="Placa RTX 3060", b="rtx placa 3060") == 1.0
    assert one(spark, text.token_similarity(F.col("a"), F.col("b")), a="", b=None) == 0.0
    assert column_of(spark, text.model_signature, ["256 GB iPhone Pro 15", "iPhone 15 Pro 256GB"]) == ["15 256gb iphone pro"] * 2


def test_redaction_and_messages(spark):
    secret = "Bearer abc.def bot123:ABCDEFGHIJKLMNOPQRSTUV sk-1234567890abcdefgh postgres://u:pw@h/db"
    got = column_of(spark, text.redact, [secret])[0]
    assert got == "Bearer [REDACTED] bot[REDACTED] [REDACTED_API_KEY] postgres://u:[REDACTED]@h/db"
    assert len(column_of(spark, text.error_message, ["x" * 3000])[0]) == 2000
    assert column_of(spark, text.escape_html, ["<a href=\"x\">'&"]) == ["&lt;a href=&quot;x&quot;&gt;&#39;&amp;"]
    assert one(spark, text.bullets(F.array(*(F.lit(str(i)) for i in range(7))), "none")).split("\n")[-1] == "• … e mais 2"
    money = [one(spark, text.money(F.lit(v).cast("double"), F.lit(c).cast("string"))) for v, c in ((1234.5, "BRL"), (None, "BRL"), (1234.5, None), (10.0, None), (1.0, "usd"))]
    assert money == ["R$ 1.234,50", "n/d", "1.234,5", "10", "USD 1,00"]


def test_hashes(spark):
    f = lambda p: hashing.fingerprint(F.lit("olx"), F.lit("Título"), F.lit(p).cast("double"), F.lit(None).cast("string"))
    import hashlib

    assert one(spark, f(69900.0)) == hashlib.sha256(b"olx|titulo|69900|").hexdigest()
    assert one(spark, f(None)) == hashlib.sha256(b"olx|titulo||").hexdigest()
    m = lambda *kv: F.create_map(*map(F.lit, kv))
    h = lambda a: hashing.content_hash(F.lit("t"), F.lit("d"), F.lit(1.0), a, F.array(F.lit("u")))
    assert one(spark, h(m("a", "1", "b", "2"))) == one(spark, h(m("b", "2", "a", "1"))) != one(spark, h(m("a", "1")))


def extract(spark, analyzer, title, description=None):
    d = analyzer.extract(Listing(F.lit(title), F.lit(description).cast("string"), F.create_map().cast("map<string,string>")))
    return spark.range(1).withColumn("d", d).select("d", analyzer.analyze(F.col("d")).alias("a"), analyzer.key(F.col("d")).alias("k")).first()


def test_gpu_models(spark):
    texts = ["GeForce RTX3060 Ti", "rtx 3060ti", "GALAX 3060 TI 8gb", "placa geforce 3060 ti", "RTX-3060 Ti", "1080 Ti", "GT 1030", "Radeon RX 6700 XT", "Arc A770", "nada"]
    got = column_of(spark, lambda t: gpu_model(text.normalize_title(t))["normalized"], texts)
    assert got == ["NVIDIA GeForce RTX 3060 TI"] * 5 + ["NVIDIA GeForce GTX 1080 TI", "NVIDIA GeForce GT 1030", "AMD Radeon RX 6700 XT", "Intel Arc A770", None]


def test_extractions(spark):
    car = extract(spark, VehicleAnalyzer(), "Volkswagen Golf 2016 automático 92.000 km", "nunca foi de leilão, revisado")
    assert (car.d.brand, car.d.model, car.d.year, car.d.mileage, car.d.transmission, car.d.condition) == ("volkswagen", "golf", 2016, 92000, "automatic", "used")
    assert car.a.risks[0].startswith("Ausência de leilão") and car.a.risk_score == 11 and car.a.feature_score == 11 and car.k == "volkswagen|golf"
    assert extract(spark, VehicleAnalyzer(), "VW Gol 2010").d.model == "gol"
    card = extract(spark, GpuAnalyzer(), "Galax RTX 3060 Ti 8GB com caixa", "garantia de 6 meses, sem mineração")
    assert (card.d.vram_gb, card.d.has_box, card.d.warranty, card.d.seller_claims_no_mining) == (8, True, "6 meses sem mineracao", True) and card.a.feature_score == 12 and card.a.risk_score == 9
    book = extract(spark, NotebookAnalyzer(), 'Dell i5-1135G7 16GB RAM 512GB SSD 15,6"', "bateria boa")
    assert (book.d.cpu_generation, book.d.ram_gb, book.d.storage_gb, book.d.storage_type, book.d.screen_inches, book.d.battery) == (11, 16, 512, "ssd", 15.6, "boa") and book.a.risks == []
    assert extract(spark, NotebookAnalyzer(), "i7-2920XM").d.cpu_generation == 2
    thing = extract(spark, GenericAnalyzer(), "Vendo Samsung Galaxy S20 usado", "sem defeito")
    assert (thing.d.brand, thing.d.model, thing.d.condition, thing.k) == ("samsung", "galaxy s20", "used", "galaxy s20") and thing.a.risk_score == 11
    assert extract(spark, GenericAnalyzer(), "TV com defeito").d.condition == "damaged"


def test_categories(spark):
    texts = ["Notebook Dell", "RTX 3060", "Carro 2015 flex", "carro flex", "Smartphone", "Mesa"]
    assert column_of(spark, lambda t: detect_category(t, F.lit(None).cast("string")), texts) == ["notebook", "gpu", "vehicle", "generic", "electronics", "generic"]
    assert one(spark, detect_category(F.lit("Mesa"), F.lit(None).cast("string"), F.lit("vehicle"))) == "vehicle"
    registry = default_registry()
    assert registry.get("chairs").category == "generic" and len(registry.list()) == 5
    with pytest.raises(ValueError):
        registry.register(GpuAnalyzer())


def test_scores(spark):
    at = lambda d, m: one(spark, scoring.combine_scores(F.lit(d), F.lit(m)))
    assert (at(80, 100), at(80, 20), at(90, 2000)) == (90, 82, 100)
    assert [one(spark, scoring.verdict(F.lit(s))) for s in (86, 70, 50, 30, 0)] == ["excellent_deal", "good", "fair", "weak", "bad"]
    assert round(one(spark, numbers.percentage_difference(F.lit(1300.0), F.lit(1520.0))), 2) == -14.47
    assert one(spark, numbers.percentage_difference(F.lit(1.0), F.lit(0.0))) is None
    assert one(spark, numbers.round_half_up(F.lit(-14.5))) == -14
    s = one(spark, scoring.deterministic_score(F.lit(700.0), F.lit(1000.0), F.lit("high"), F.lit(1000.0), F.lit("x" * 80), F.lit(3), F.lit(1), F.lit(20), F.lit(14)))
    assert s.score == 35 + 10 + 15 + 10 + 14 + 5 == 89


def test_filters(spark):
    listing = F.struct(F.lit("BMW X1 2015").alias("title"), F.lit(None).cast("string").alias("description"), F.lit(50000.0).alias("price"), F.lit("Itajaí, SC").alias("location"))

    def why(year=2015, **search):
        kinds = {"category": "string", "query": "string", "min_price": "double", "max_price": "double", "min_year": "int", "max_year": "int", "location": "string", "radius_km": "int"}
        s = F.struct(*(F.lit(search.get(k)).cast(t).alias(k) for k, t in kinds.items()), F.array(*map(F.lit, search.get("forbidden", []))).cast("array<string>").alias("forbidden_words"))
        return one(spark, filters.filter_reasons(listing, s, F.lit("vehicle"), F.lit(year).cast("int")))

    assert why(category="vehicle", query="BMW 320i") == ["query_mismatch"]
    assert why(category="vehicle", query="bmw x1") == []
    assert why(category="gpu", min_price=60000.0, max_price=40000.0) == ["below_minimum_price", "over_budget", "category_mismatch"]
    assert why(category="generic", forbidden=["x1", "leilão"], min_year=2016, max_year=2014) == ["forbidden_word:x1", "year_below_minimum", "year_above_maximum"]
    assert why(year=None, category="generic", min_year=2016) == ["year_below_minimum"]
    assert why(category="generic", location="Itajaí, PR", radius_km=20) == ["location_mismatch"]
    assert why(category="generic", location="Itajai - SC", radius_km=20) == [] == why(category="generic", location="itajai")


def test_due(spark):
    now = datetime(2024, 1, 1, 12)
    df = spark.createDataFrame([(1, True, None, 60), (2, True, datetime(2024, 1, 1, 11), 60), (3, True, datetime(2024, 1, 1, 11, 30), 60), (4, False, None, 60)], "i int, active boolean, last_run_at timestamp_ntz, interval_minutes int")
    assert [r.i for r in df.where(filters.due(now)).orderBy("i").collect()] == [1, 2]
