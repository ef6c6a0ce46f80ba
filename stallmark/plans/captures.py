"""Queries over captured cards, pages and API payloads, made of the rows of `part`, and over the checks they pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallmark import shared
from stallmark.functions.numbers import parse_price
from stallmark.functions.urls import first_party_id, short_url
from stallmark.operators import runs, validation
from stallmark.plans import views
from stallmark.sources import pages, parsers, registry

_REAIS = "floor(p_retailprice)::BIGINT"
#: A price as its text says it, and what it is worth: cents on every third part.
_PRICE_SQL = f"({_REAIS} + CASE WHEN p_partkey % 3 = 0 THEN 0.5 ELSE 0 END)::DOUBLE"
_SUMMARY_SQL = "source, external_id, title, price, currency, location, url, image_url"


def _k() -> Column:
    return F.col("p_partkey")


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part with its price as an advertisement writes it."""
    reais = F.floor("p_retailprice")
    text = F.when(reais >= 1000, F.concat(F.floor(reais / 1000).cast("string"), F.lit("."), F.lpad((reais % 1000).cast("string"), 3, "0"))).otherwise(reais.cast("string"))
    return views.dealt(views.table(spark, sf_dir, "part"), "p_partkey").withColumn("said", F.concat(F.lit("R$ "), text, F.when(_k() % 3 == 0, ",50").otherwise("")))


def _lines(*items: Column | str) -> Column:
    return F.concat_ws("\n", *(F.lit(x) if isinstance(x, str) else x for x in items))


def _number(base: int) -> Column:
    return (_k() + base).cast("string")


def _image() -> Column:
    return F.when(_k() % 2 == 0, F.concat(F.lit("https://img.example/"), _k().cast("string"))).otherwise(F.concat(F.lit("data:"), _k().cast("string")))


def facebook_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards with a price first, two prices, none, or a label; every eleventh is empty and dropped."""
    p, name = parts(spark, sf_dir), F.col("p_name")
    text = F.when(_k() % 4 == 1, _lines(F.col("said"), "R$ 9.999", F.concat(F.lit("  "), name, F.lit(" ")), "Curitiba, PR")).when(_k() % 4 == 2, _lines(name, "São Paulo, SP")).otherwise(_lines(F.col("said"), name, "Joinville, SC"))
    cards = p.select(
        F.concat(F.lit("https://www.facebook.com/marketplace/item/"), _number(100000), F.lit("/?ref=search")).alias("href"),
        F.when(_k() % 11 == 0, "").otherwise(text).alias("text"),
        F.when((_k() % 4 == 3) & (_k() % 11 != 0), F.concat(F.lit(" Anúncio  "), name)).alias("aria_label"),
        _image().alias("image"),
    )
    return parsers.facebook_cards(cards)


FACEBOOK_CARDS = f"""SELECT 'facebook' AS source, (100000 + p_partkey)::VARCHAR AS external_id, CASE WHEN p_partkey % 4 = 3 THEN concat('Anúncio ', p_name) ELSE p_name END AS title,
 CASE WHEN p_partkey % 4 <> 2 THEN {_PRICE_SQL} END AS price, CASE WHEN p_partkey % 4 <> 2 THEN 'BRL' END AS currency,
 CASE p_partkey % 4 WHEN 1 THEN 'Curitiba, PR' WHEN 2 THEN 'São Paulo, SP' ELSE 'Joinville, SC' END AS location,
 concat('https://www.facebook.com/marketplace/item/', 100000 + p_partkey, '/?ref=search') AS url, CASE WHEN p_partkey % 2 = 0 THEN concat('https://img.example/', p_partkey) END AS image_url FROM part WHERE p_partkey % 11 <> 0"""


def olx_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards whose title stands alone or only in the first line; every thirteenth has neither and is dropped."""
    p = parts(spark, sf_dir)
    cards = p.select(
        F.concat(F.lit("https://sc.olx.com.br/norte/anuncio-"), _number(1000000)).alias("href"),
        F.when((_k() % 3 != 0) & (_k() % 13 != 0), F.concat(F.lit("O "), F.col("p_name"))).alias("title"),
        F.when(_k() % 13 == 0, "").when(_k() % 5 == 0, _lines(F.col("p_name"), "Joinville, SC 10:30")).otherwise(_lines(F.col("p_name"), F.col("said"), "Joinville, SC 10:30")).alias("text"),
        _image().alias("image"),
    )
    return parsers.olx_cards(cards)


OLX_CARDS = f"""SELECT 'olx' AS source, (1000000 + p_partkey)::VARCHAR AS external_id, CASE WHEN p_partkey % 3 = 0 THEN p_name ELSE concat('O ', p_name) END AS title, CASE WHEN p_partkey % 5 <> 0 THEN {_PRICE_SQL} END AS price,
 CASE WHEN p_partkey % 5 <> 0 THEN 'BRL' END AS currency, 'Joinville, SC 10:30' AS location, concat('https://sc.olx.com.br/norte/anuncio-', 1000000 + p_partkey) AS url,
 CASE WHEN p_partkey % 2 = 0 THEN concat('https://img.example/', p_partkey) END AS image_url FROM part WHERE p_partkey % 13 <> 0"""


def mercadolivre_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards with the item in the path, in a parameter, or nowhere (dropped), without price or within a range."""
    href = F.when(_k() % 3 == 0, F.concat(F.lit("https://produto.mercadolivre.com.br/MLB-"), _number(1000000), F.lit("-item"))).when(_k() % 3 == 1, F.concat(F.lit("https://www.mercadolivre.com.br/p/MLB77?wid=MLB"), _number(2000000))).otherwise("https://www.mercadolivre.com.br/ofertas")
    cards = parts(spark, sf_dir).select(href.alias("href"), "p_name", F.when(_k() % 7 != 0, F.col("said")).alias("price_text"), _image().alias("image"), F.when(_k() % 2 == 0, "  Joinville ").alias("location")).withColumnRenamed("p_name", "title")
    return parsers.within_prices(parsers.mercadolivre_cards(cards), 950, 1500)


MERCADOLIVRE_CARDS = f"""WITH c AS (SELECT 'mercadolivre' AS source, concat('MLB', CASE p_partkey % 3 WHEN 0 THEN 1000000 ELSE 2000000 END + p_partkey) AS external_id, p_name AS title, CASE WHEN p_partkey % 7 <> 0 THEN {_PRICE_SQL} END AS price,
 CASE WHEN p_partkey % 7 <> 0 THEN 'BRL' END AS currency, CASE WHEN p_partkey % 2 = 0 THEN 'Joinville' END AS location,
 CASE p_partkey % 3 WHEN 0 THEN concat('https://produto.mercadolivre.com.br/MLB-', 1000000 + p_partkey, '-item') ELSE concat('https://www.mercadolivre.com.br/p/MLB77?wid=MLB', 2000000 + p_partkey) END AS url,
 CASE WHEN p_partkey % 2 = 0 THEN concat('https://img.example/', p_partkey) END AS image_url FROM part WHERE p_partkey % 3 <> 2) SELECT * FROM c WHERE price IS NULL OR price BETWEEN 950 AND 1500"""


def _entries(attributes: Column) -> Column:
    return F.array_join(F.array_sort(F.transform(F.map_entries(attributes), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")


def facebook_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Visible page texts to detail documents; every fifth page has no description and no seller."""
    body = _lines("Descrição do vendedor", F.col("p_name"), " segunda linha ", "Informações do vendedor", "Maria", "Marca", F.col("p_brand"))
    head = _lines("Notificações", F.col("said"), "Joinville, SC", "Condição", "Usado")
    pages = parts(spark, sf_dir).withColumn("d", parsers.facebook_page(F.when(_k() % 5 == 0, head).otherwise(_lines(head, body))))
    return pages.select(_k(), parse_price(F.col("d.price_text")).alias("price"), "d.location", "d.description", "d.seller_name", _entries(F.col("d.attributes")).alias("attributes"))


FACEBOOK_PAGES = f"""SELECT p_partkey, {_PRICE_SQL} AS price, 'Joinville, SC' AS location,
 CASE WHEN p_partkey % 5 <> 0 THEN concat(p_name, chr(10), 'segunda linha', chr(10), 'Informações do vendedor', chr(10), 'Maria', chr(10), 'Marca', chr(10), p_brand) END AS description,
 CASE WHEN p_partkey % 5 <> 0 THEN 'Maria' END AS seller_name, CASE WHEN p_partkey % 5 <> 0 THEN concat('Condição=Usado;Marca=', p_brand) ELSE 'Condição=Usado' END AS attributes FROM part"""


def json_ld(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The product of a page's JSON-LD: alone, in an array, in a graph, or broken."""
    product = F.concat(F.lit('{"@type":"Product","name":"'), F.col("p_name"), F.lit('","offers":{"price":'), F.floor("p_retailprice").cast("string"), F.lit("}}"))
    other = F.lit('{"@type":"WebSite","name":"site"}')
    script = F.when(_k() % 7 == 0, '{"@type":"Product",').when(_k() % 3 == 0, product).when(_k() % 3 == 1, F.concat(F.lit("["), other, F.lit(","), product, F.lit("]"))).otherwise(F.concat(F.lit('{"@graph":['), other, F.lit(","), product, F.lit("]}")))
    html = F.concat(F.lit('<html><script type="application/ld+json">'), script, F.lit("</script></html>"))
    found = views.table(spark, sf_dir, "part").withColumn("v", parsers.json_ld_product(html))
    return found.select(_k(), F.try_variant_get("v", "$.name", "string").alias("name"), F.try_variant_get("v", "$.offers.price", "double").alias("price"))


JSON_LD = "SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_name END AS name, CASE WHEN p_partkey % 7 <> 0 THEN floor(p_retailprice)::DOUBLE END AS price FROM part"


def listed_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.array(F.lit("Cor: azul"), F.concat(F.lit(" Marca : "), F.col("p_brand")), F.lit("sem valor"), F.when(_k() % 2 == 0, "Cor: verde").otherwise("Hora: 10:30"))
    return views.table(spark, sf_dir, "part").select(_k(), _entries(parsers.listed_attributes(lines)).alias("attributes"))


LISTED_ATTRIBUTES = "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN concat('Cor=verde;Marca=', p_brand) ELSE concat('Cor=azul;Hora=10:30;Marca=', p_brand) END AS attributes FROM part"


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    city, state = F.when(_k() % 3 != 0, "Joinville"), F.when(_k() % 4 != 0, "Santa Catarina")
    picture = F.struct(F.when(_k() % 2 == 0, F.concat(F.lit("https://img.example/"), _k().cast("string"))).alias("secure_url"), F.lit("http://img.example/plain").alias("url"))
    return views.table(spark, sf_dir, "part").select(
        F.concat(F.lit("MLB"), _k().cast("string")).alias("id"), F.col("p_name").alias("title"), F.col("p_retailprice").alias("price"), F.lit("BRL").alias("currency_id"), F.concat(F.lit("https://produto.mercadolivre.com.br/MLB"), _k().cast("string")).alias("permalink"),
        F.when(_k() % 5 == 0, F.concat(F.lit("https://thumb.example/"), _k().cast("string"))).alias("thumbnail"), F.struct(city.alias("city_name"), state.alias("state_name")).alias("address"),
        F.struct(F.struct(city.alias("name")).alias("city"), F.struct(state.alias("name")).alias("state")).alias("seller_address"), F.array(picture, F.struct(F.lit("data:x").alias("secure_url"), F.lit(None).cast("string").alias("url"))).alias("pictures"),
        F.array(F.struct(F.lit("Marca").alias("name"), F.col("p_brand").alias("value_name"), F.lit("7").alias("value_id")), F.struct(F.lit("Cor").alias("name"), F.lit(None).cast("string").alias("value_name"), F.lit("azul").alias("value_id"))).alias("attributes"),
        F.when(_k() % 6 == 0, "bad date").otherwise("2001-02-03T04:05:06").alias("date_created"),
    )


_PLACE_SQL = "nullif(concat_ws(', ', CASE WHEN p_partkey % 3 <> 0 THEN 'Joinville' END, CASE WHEN p_partkey % 4 <> 0 THEN 'Santa Catarina' END), '')"
_ITEM_SQL = f"'mercadolivre' AS source, concat('MLB', p_partkey) AS external_id, p_name AS title, p_retailprice AS price, 'BRL' AS currency, {_PLACE_SQL} AS location, concat('https://produto.mercadolivre.com.br/MLB', p_partkey) AS url"


def api_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parsers.api_items(_items(spark, sf_dir))


API_ITEMS = f"SELECT {_ITEM_SQL}, CASE WHEN p_partkey % 5 = 0 THEN concat('https://thumb.example/', p_partkey) END AS image_url FROM part"


def api_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API items with their descriptions, where there are any: plain text first."""
    items = _items(spark, sf_dir)
    texts = items.where(F.length("id") % 2 == 0).select("id", F.when(F.length("title") % 2 == 0, F.concat(F.lit("plain "), F.col("title"))).alias("plain_text"), F.concat(F.lit("rich "), F.col("title")).alias("text"))
    out = parsers.api_details(items, texts)
    return out.select(*_SUMMARY_SQL.split(", "), "description", F.array_join("images", " ").alias("images"), _entries(F.col("attributes")).alias("attributes"), "published_at")


API_DETAILS = f"""WITH i AS (SELECT {_ITEM_SQL}, CASE WHEN p_partkey % 2 = 0 THEN concat('https://img.example/', p_partkey) ELSE 'http://img.example/plain' END AS images, p_partkey, p_brand FROM part)
 SELECT source, external_id, title, price, currency, location, url, CASE WHEN p_partkey % 5 = 0 THEN concat('https://thumb.example/', p_partkey) ELSE images END AS image_url,
 CASE WHEN length(external_id) % 2 = 0 THEN CASE WHEN length(title) % 2 = 0 THEN concat('plain ', title) ELSE concat('rich ', title) END END AS description, images, concat('Cor=azul;Marca=', p_brand) AS attributes,
 CASE WHEN p_partkey % 6 <> 0 THEN TIMESTAMP '2001-02-03 04:05:06' END AS published_at FROM i"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A search for each brand, its parts in pages of 50 by key; every response of a search names the same total, seven
    eighths of its largest key, beyond which pages were captured too."""
    p = views.table(spark, sf_dir, "part")
    item = F.struct(_k().alias("at"), F.concat(F.lit("MLB"), _k().cast("string")).alias("id"), F.col("p_name").alias("title"), F.when(F.col("p_size") % 7 != 0, F.col("p_retailprice")).alias("price"), F.lit("BRL").alias("currency_id"))
    bodies = p.groupBy("p_brand", (F.floor(_k() / 50) * 50).alias("offset")).agg(F.array_sort(F.collect_list(item)).alias("results"))
    totals = p.groupBy("p_brand").agg(F.floor(F.max("p_partkey") * 7 / 8).alias("total"))
    body = F.to_json(F.struct("results", F.struct("total").alias("paging")))
    return bodies.join(totals, "p_brand").select(F.lit("mercadolivre").alias("source"), F.col("p_brand").alias("query"), "offset", body.alias("body"))


_PAGES_SQL = """pages AS (SELECT p_brand AS query, p_partkey - p_partkey % 50 + row_number() OVER (PARTITION BY p_brand, p_partkey // 50 ORDER BY p_partkey) - 1 AS seq, concat('MLB', p_partkey) AS id, p_name AS title,
 CASE WHEN p_size % 7 <> 0 THEN p_retailprice END AS price FROM part JOIN (SELECT p_brand, floor(max(p_partkey) * 7 / 8) AS total FROM part GROUP BY p_brand) USING (p_brand) WHERE p_partkey - p_partkey % 50 < total)"""


def api_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of 50 items as JSON, read back to items in order; the total of each search ends them."""
    return registry.paged_items(_pages(spark, sf_dir), "struct<id:string,title:string,price:double>", keys=("query",))


API_PAGES = f"WITH {_PAGES_SQL} SELECT query, seq, id, title, price FROM pages"


def page_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same pages as a store, read through its data source within a range of prices: bundles and pages out of it stay
    unread, and so do those past a search's total."""
    path = shared.fresh_path(spark, "pages")
    pages.write_pages(_pages(spark, sf_dir), path, bundle_pages=16)
    return pages.read_pages(spark, path).where("price >= 930 and price < 1040").select("source", "slug", "seq", "id", "title", "price", "currency_id")


PAGE_SOURCE = f"WITH {_PAGES_SQL} SELECT 'mercadolivre' AS source, replace(lower(query), '#', '-') AS slug, seq, id, title, price, 'BRL' AS currency_id FROM pages WHERE price >= 930 AND price < 1040"


def merged_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries with what their detail documents know better, field by field."""
    p = parts(spark, sf_dir)
    text = lambda c: F.lit(c).cast("string")
    summaries = p.select(_k().alias("seq"), F.lit("olx").alias("source"), _number(1000000).alias("external_id"), F.col("p_name").alias("title"), F.lit(5.0).alias("price"), text(None).alias("currency"), F.lit("Brasil").alias("location"), F.lit("https://sc.olx.com.br/x").alias("url"), text(None).alias("image_url"))
    details = p.where(_k() % 9 != 0).select(
        _k().alias("seq"), F.when(_k() % 2 == 0, F.concat(F.lit("  novo "), F.col("p_name"))).alias("title"), F.when(_k() % 4 != 0, F.lit(" descrição  longa ")).alias("description"), F.when(_k() % 3 == 0, F.col("said")).alias("price_text"), F.when(_k() % 5 == 0, "  ").otherwise("Joinville").alias("location"),
        F.lit("Ana").alias("seller_name"), F.array(F.lit("data:x"), F.concat(F.lit("https://img.example/"), _k().cast("string")), F.concat(F.lit("https://img.example/"), _k().cast("string"))).alias("images"), F.create_map(F.lit("Marca"), F.col("p_brand")).alias("attributes"), F.when(_k() % 2 == 0, "2001-02-03 04:05:06").otherwise("ontem").alias("published_at"),
    )
    out = parsers.merge_details(summaries, details)
    return out.select("seq", "title", "price", "currency", "location", "image_url", "description", "seller_name", F.size("images").cast("long").alias("images"), _entries(F.col("attributes")).alias("attributes"), F.col("published_at").cast("timestamp_ntz").alias("published_at"))


MERGED_DETAILS = f"""SELECT p_partkey AS seq, CASE WHEN p_partkey % 2 = 0 THEN concat('novo ', p_name) ELSE p_name END AS title, CASE WHEN p_partkey % 3 = 0 THEN {_PRICE_SQL} ELSE 5.0 END::DOUBLE AS price, CASE WHEN p_partkey % 3 = 0 THEN 'BRL' END AS currency,
 CASE WHEN p_partkey % 5 = 0 THEN 'Brasil' ELSE 'Joinville' END AS location, concat('https://img.example/', p_partkey) AS image_url, CASE WHEN p_partkey % 4 <> 0 THEN 'descrição longa' END AS description, 'Ana' AS seller_name, 1::BIGINT AS images,
 concat('Marca=', p_brand) AS attributes, CASE WHEN p_partkey % 2 = 0 THEN TIMESTAMP '2001-02-03 04:05:06' END AS published_at FROM part WHERE p_partkey % 9 <> 0"""


def first_party_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listing numbers in URLs, and URLs as a message may carry them."""
    source = F.when(_k() % 3 == 0, "facebook").when(_k() % 3 == 1, "olx").otherwise("mercadolivre")
    url = F.when(_k() % 5 == 0, "https://www.olx.com.br/busca").when(_k() % 3 == 0, F.concat(F.lit("https://m.facebook.com/marketplace/item/"), _number(0))).when(_k() % 3 == 1, F.concat(F.lit("https://olx.com.br/a-"), _number(1000000), F.lit("/?"), F.repeat(F.lit("x"), _k().cast("int") % 700)))
    url = url.otherwise(F.concat(F.lit("https://lista.mercadolivre.com.br/x?q=item_id%3AMLB"), _number(3000000)))
    rows = views.table(spark, sf_dir, "part").withColumns({"source": source, "url": url})
    return rows.select(_k(), first_party_id(F.col("source"), F.col("url")).alias("external_id"), short_url(F.col("source"), F.col("url")).alias("short"))


FIRST_PARTY_IDS = """WITH u AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 5 = 0 THEN 'https://www.olx.com.br/busca' WHEN p_partkey % 3 = 0 THEN concat('https://m.facebook.com/marketplace/item/', p_partkey)
 WHEN p_partkey % 3 = 1 THEN concat('https://olx.com.br/a-', 1000000 + p_partkey, '/?', repeat('x', (p_partkey % 700)::INT)) ELSE concat('https://lista.mercadolivre.com.br/x?q=item_id%3AMLB', 3000000 + p_partkey) END AS url FROM part)
 SELECT k AS p_partkey, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 3 = 0 THEN k::VARCHAR WHEN k % 3 = 1 THEN (1000000 + k)::VARCHAR ELSE concat('MLB', 3000000 + k) END AS external_id,
 CASE WHEN k % 5 = 0 AND k % 3 <> 1 THEN NULL WHEN length(url) <= 600 THEN url ELSE split_part(url, '?', 1) END AS short FROM u"""


def gate_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every feed row that a run of one provider takes or turns away, with the reasons."""
    n = F.col("l_partkey") % 5
    url = F.when(n == 0, "http://sc.olx.com.br/a-1234567").when(n == 1, "https://olx.com.br.example.org/a-1234567").when(n == 2, "no url").when(n == 3, "https://user@sc.olx.com.br/a-1234567").otherwise("https://sc.olx.com.br/a-1234567")
    rows = views.feed(spark, sf_dir).withColumns({"url": url, "image_url": F.when(F.col("l_suppkey") % 2 == 0, "ftp://x/y"), "currency": F.when(F.col("l_suppkey") % 5 == 0, "R$").otherwise(F.col("currency"))})
    key = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    return rows.select(*key, F.array_join(validation.gate_reasons(F.lit("olx")), ",").alias("reasons"))


GATE_REASONS = f"""WITH {views.FEED} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, concat_ws(',', CASE WHEN l_suppkey % 5 = 0 THEN 'currency' END, CASE WHEN l_partkey % 5 = 2 THEN 'url' END, CASE WHEN l_suppkey % 2 = 0 THEN 'image_url' END,
 CASE WHEN source <> 'olx' THEN 'provider' END, CASE WHEN source <> 'olx' OR l_partkey % 5 <> 4 THEN 'host' END) AS reasons FROM feed"""


def details_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = _k()
    rows = parts(spark, sf_dir).select(
        k, F.lit("olx").alias("source"), F.lit("1").alias("external_id"), F.when(k % 19 == 0, "  ").otherwise(F.col("p_name")).alias("title"), F.when(k % 17 == 0, -1.0).otherwise(F.col("p_retailprice")).alias("price"), F.lit("BRL").alias("currency"), F.lit("SC").alias("location"), F.lit("https://olx.com.br/a").alias("url"), F.lit(None).cast("string").alias("image_url"),
        F.repeat(F.lit("x"), F.when(k % 50 == 0, 100_001).otherwise(9).cast("int")).alias("description"), F.repeat(F.lit("n"), F.when(k % 7 == 0, 501).otherwise(500).cast("int")).alias("seller_name"),
        F.array_repeat(F.when(k % 13 == 0, "nothing").otherwise("https://img.example/1"), F.when(k % 11 == 0, 51).otherwise(50).cast("int")).alias("images"),
        F.map_from_arrays(F.transform(F.sequence(F.lit(1), F.when(k % 3 == 0, 201).otherwise(200).cast("int")), lambda i: i.cast("string")), F.array_repeat(F.lit("v"), F.when(k % 3 == 0, 201).otherwise(200).cast("int"))).alias("attributes"),
    )
    return rows.select("p_partkey", F.array_join(validation.details_reasons(), ",").alias("reasons"))


DETAILS_REASONS = """SELECT p_partkey, concat_ws(',', CASE WHEN p_partkey % 19 = 0 THEN 'title' END, CASE WHEN p_partkey % 17 = 0 THEN 'price' END, CASE WHEN p_partkey % 50 = 0 THEN 'description' END, CASE WHEN p_partkey % 7 = 0 THEN 'seller_name' END,
 CASE WHEN p_partkey % 11 = 0 OR p_partkey % 13 = 0 THEN 'images' END, CASE WHEN p_partkey % 3 = 0 THEN 'attributes' END) AS reasons FROM part"""


def matching_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Details that belong to their summary: source, id and host agree."""
    p = views.table(spark, sf_dir, "part")
    summaries = p.select(_k().alias("seq"), F.lit("olx").alias("source"), F.when(_k() % 4 != 0, _number(0)).alias("external_id"))
    details = p.select(_k().alias("seq"), F.when(_k() % 7 == 0, "facebook").otherwise("olx").alias("source"), F.when(_k() % 5 == 0, "other").otherwise(_number(0)).alias("external_id"), F.when(_k() % 3 == 0, "https://example.org/a").otherwise("https://sc.olx.com.br/a").alias("url"))
    return validation.matching_details(summaries, details).select("seq", "source", "external_id", "url")


MATCHING_DETAILS = """SELECT p_partkey AS seq, 'olx' AS source, CASE WHEN p_partkey % 5 = 0 THEN 'other' ELSE p_partkey::VARCHAR END AS external_id, 'https://sc.olx.com.br/a' AS url FROM part
 WHERE p_partkey % 7 <> 0 AND p_partkey % 3 <> 0 AND (p_partkey % 4 = 0 OR p_partkey % 5 <> 0)"""


def numbers_or_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(_k() % 5 == 0, F.concat(F.lit(" "), _k().cast("string"), F.lit(".5 "))).when(_k() % 5 == 1, "abc").when(_k() % 5 == 2, "  ").when(_k() % 5 == 3, "Infinity")
    return views.table(spark, sf_dir, "part").withColumn("n", validation.number_or_error(said)).select(_k(), "n.value", "n.error")


NUMBERS_OR_ERRORS = "SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN p_partkey + 0.5 END::DOUBLE AS value, p_partkey % 5 IN (1, 3) AS error FROM part"


def category_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored category fields read by their declared schema; unknown keys go, what is no JSON is null."""
    stored = F.when(_k() % 4 == 0, "{broken").when(_k() % 4 == 1, F.concat(F.lit('{"brand":"'), F.col("p_brand"), F.lit('","year":'), F.col("p_size").cast("string"), F.lit(',"other":[1]}'))).when(_k() % 4 == 2, F.concat(F.lit('{"year":'), F.col("p_size").cast("string"), F.lit("}")))
    return views.table(spark, sf_dir, "part").withColumn("d", validation.category_data(stored, "brand string, year int")).select(_k(), "d.brand", "d.year", F.col("d").isNotNull().alias("known"))


CATEGORY_DATA = "SELECT p_partkey, CASE WHEN p_partkey % 4 = 1 THEN p_brand END AS brand, CASE WHEN p_partkey % 4 IN (1, 2) THEN p_size END AS year, p_partkey % 4 IN (1, 2) AS known FROM part"


def search_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every part as an arrival of a listing (several share an identity), through a provider's search: the first arrival of
    an identity decides, the range of prices then drops it or not, and the 200 first are the result."""
    p = views.table(spark, sf_dir, "part")
    rows = p.select(_k().alias("seq"), F.lit("mercadolivre").alias("source"), F.concat(F.lit("MLB"), F.col("p_size").cast("string"), F.lit("-"), F.col("p_brand"), (_k() % 97).cast("string")).alias("external_id"), F.col("p_name").alias("title"), F.when(_k() % 11 != 0, F.col("p_retailprice")).alias("price"), F.lit("BRL").alias("currency"), F.lit("Brasil").alias("location"), F.lit("https://www.mercadolivre.com.br/x").alias("url"), F.lit(None).cast("string").alias("image_url"))
    searches = registry.ProviderRegistry()
    searches.register("mercadolivre", lambda s, c: rows, filter_prices=True)
    good, _ = searches.search(spark, "mercadolivre", registry.Criteria("peças", 1000.0, 1500.0, limit=200))
    return good.select("seq", "external_id", "price")


SEARCH_ORDER = """WITH r AS (SELECT p_partkey AS seq, concat('MLB', p_size, '-', p_brand, p_partkey % 97) AS external_id, CASE WHEN p_partkey % 11 <> 0 THEN p_retailprice END AS price FROM part),
 f AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY external_id ORDER BY seq) = 1) SELECT * FROM f WHERE price IS NULL OR price BETWEEN 1000 AND 1500 ORDER BY seq LIMIT 200"""


_HOST = "CASE WHEN l_partkey % 5 = 0 THEN 'https://example.com/' WHEN source = 'facebook' THEN 'https://www.facebook.com/marketplace/item/' WHEN source = 'olx' THEN 'https://sc.olx.com.br/item-' ELSE 'https://produto.mercadolivre.com.br/MLB-' END"
_PROVIDER = "CASE WHEN l_partkey % 9 = 0 THEN 'facebook' ELSE source END"


def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run over all arrivals, written once, and what it counted on the way: received, turned away by reason, discovered and
    analysed (those with a price)."""
    rows = views.feed(spark, sf_dir).withColumns(
        {
            "provider": F.expr(_PROVIDER), "url": F.concat(F.expr(_HOST), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")), "seq": F.xxhash64(*views.ARRIVAL), "image_url": F.when(F.col("l_suppkey") % 4 == 0, "ftp://x/y"),
            "price": F.when(F.col("l_orderkey") % 53 == 0, -1.0).otherwise(F.col("price")), "currency": F.when(F.col("l_suppkey") % 5 == 0, "R$").otherwise(F.col("currency")),
        }
    )
    counters = runs.Counters()
    out = runs.counted_run(rows, F.col("provider"), lambda found: found.where("price is not null"), counters)
    out.select("source", "external_id", "url", "price").write.parquet(shared.fresh_path(spark, "run"))
    return counters.table(spark)


RUN_COUNTERS = f"""WITH {views.FEED}, r AS (SELECT *, {_PROVIDER} AS provider, concat({_HOST}, l_orderkey, '-', l_linenumber) AS own_url, CASE WHEN l_orderkey % 53 = 0 THEN -1 ELSE price END AS p, l_suppkey % 5 = 0 AS bad_currency, l_suppkey % 4 = 0 AS bad_image FROM feed),
 j AS (SELECT *, source <> provider AS bad_provider, l_partkey % 5 = 0 AS bad_host, coalesce(p < 0, false) AS bad_price FROM r), g AS (SELECT * FROM j WHERE NOT (bad_currency OR bad_image OR bad_provider OR bad_host OR bad_price)),
 d AS (SELECT DISTINCT source, coalesce(external_id, own_url) AS identity, p IS NOT NULL AS priced FROM g), c AS (SELECT 'received' AS stage, unnest([{", ".join(f"{{'counter': '{n}', 'n': {e}}}" for n, e in {"rows": "count(*)", "rejected": "count(*) FILTER (bad_currency OR bad_image OR bad_provider OR bad_host OR bad_price)", **{f"rejected_{r}": f"count(*) FILTER ({'bad_' + dict(image_url='image').get(r, r)})" if r in ("price", "currency", "image_url", "provider", "host") else "0" for r in runs.REASONS}}.items())}]) AS x FROM j)
 SELECT stage, x.counter AS counter, x.n AS n FROM c UNION ALL SELECT 'discovered', 'rows', count(*) FROM d UNION ALL SELECT 'analysed', 'rows', count(*) FROM d WHERE priced"""
