"""Captured cards, pages and API payloads to summaries and details."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallmark.functions.numbers import parse_price
from stallmark.functions.text import match, nullable_text, once
from stallmark.functions.urls import first_party_id

#: Patterns of price lines and of titles that are navigation.
PRICE = r"(?i)R\$\s*[\d.]+(?:,\d{2})?"
NAVIGATION = "(?i)^(notifica[cç][oõ]es|notifications|facebook|marketplace)$"


def lines_of(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def first_where(items: Column, test) -> Column:
    return F.get(F.filter(items, test), 0)


def http_or_null(url: Column) -> Column:
    return F.when(url.rlike("(?i)^https?://"), url)


def _summary(source: str, external_id: Column, title: Column, price: Column, currency: Column, location: Column, url: Column, image: Column) -> list[Column]:
    return [F.lit(source).alias("source"), external_id.alias("external_id"), title.alias("title"), price.alias("price"), currency.alias("currency"), location.alias("location"), url.alias("url"), http_or_null(image).alias("image_url")]


def facebook_cards(df: DataFrame) -> DataFrame:
    """href, text, aria_label, image to summaries; cards without a title are dropped."""
    df = df.withColumn("_lines", lines_of(F.col("text")))
    df = df.withColumn("_price", first_where(F.col("_lines"), lambda x: x.rlike(PRICE)))
    named = first_where(F.col("_lines"), lambda x: ~x.eqNullSafe(F.col("_price")) & ~x.rlike(r"^R\$") & (F.length(x) > 2))
    title = F.coalesce(nullable_text(F.col("aria_label")), named)
    place = first_where(F.col("_lines"), lambda x: x.rlike(r",\s*[A-Z]{2}(?![A-Za-z0-9_])"))
    rows = df.withColumns({"_title": title, "_place": place}).where("_title is not null")
    return rows.select(*_summary("facebook", first_party_id(F.lit("facebook"), F.col("href")), F.col("_title"), parse_price(F.col("_price")), F.when(F.col("_price").isNotNull(), "BRL"), F.col("_place"), F.col("href"), F.col("image")))


def olx_cards(df: DataFrame) -> DataFrame:
    """href, title, text, image to summaries; cards without a title are dropped."""
    title = F.coalesce(nullable_text(F.col("title")), nullable_text(F.get(F.split("text", "\n"), F.lit(0))))
    price = match(F.col("text"), f"({PRICE})")
    place = first_where(lines_of(F.col("text")), lambda x: x.rlike(r"(?<![A-Za-z0-9_])[A-Z]{2}(?![A-Za-z0-9_])") & ~F.contains(x, F.lit("R$")))
    rows = df.withColumns({"_title": title, "_price": price, "_place": place}).where("_title is not null")
    return rows.select(*_summary("olx", first_party_id(F.lit("olx"), F.col("href")), F.col("_title"), parse_price(F.col("_price")), F.when(F.col("_price").isNotNull(), "BRL"), F.col("_place"), F.col("href"), F.col("image")))


def mercadolivre_cards(df: DataFrame) -> DataFrame:
    """href, title, price_text, image, location to summaries; title and id are both needed."""
    rows = df.withColumns({"_title": nullable_text(F.col("title")), "_id": first_party_id(F.lit("mercadolivre"), F.col("href")), "_price": once(F.col("price_text"), parse_price)}).where("_title is not null and _id is not null")
    return rows.select(*_summary("mercadolivre", F.col("_id"), F.col("_title"), F.col("_price"), F.when(F.col("_price").isNotNull(), "BRL"), nullable_text(F.col("location")), F.col("href"), F.col("image")))


def within_prices(df: DataFrame, low: float | None, high: float | None) -> DataFrame:
    """Rows without price, or with one in the range."""
    ok = F.lit(True)
    if low is not None:
        ok = ok & (F.col("price") >= low)
    if high is not None:
        ok = ok & (F.col("price") <= high)
    return df.where(F.col("price").isNull() | ok)


def usable_title(title: Column) -> Column:
    """A page title without the site's suffix; null for those of navigation."""
    bare = F.trim(F.regexp_replace(nullable_text(title), r"(?i)\s*[|·]\s*Facebook(?: Marketplace)?\s*$", ""))
    return F.when((bare != "") & ~bare.rlike(NAVIGATION), bare)


def merge_details(summaries: DataFrame, details: DataFrame, on: str = "seq", title=nullable_text) -> DataFrame:
    """Summaries with what their detail documents (title, description, price_text, location, seller_name, images,
    attributes, published_at as text) know better."""
    d = details.select(F.col(on).alias("_on"), F.struct("title", "description", "price_text", "location", "seller_name", "images", "attributes", "published_at").alias("d"))
    joined = summaries.join(d, F.col(on) == F.col("_on")).withColumn("_price", parse_price(F.col("d.price_text")))
    images = F.slice(F.array_distinct(F.filter("d.images", lambda u: u.rlike("(?i)^https?://"))), 1, 50)
    entries = F.slice(F.map_entries("d.attributes"), 1, 200)
    joined = joined.withColumn("_images", images)
    new = {
        "title": F.coalesce(title(F.col("d.title")), F.col("title")),
        "price": F.coalesce("_price", "price"),
        "currency": F.when(F.col("_price").isNotNull(), "BRL").otherwise(F.col("currency")),
        "location": F.coalesce(nullable_text(F.col("d.location")), F.col("location")),
        "image_url": F.coalesce(F.get("_images", F.lit(0)), F.col("image_url")),
    }
    extra = [F.left(nullable_text(F.col("d.description")), F.lit(100_000)).alias("description"), F.left(nullable_text(F.col("d.seller_name")), F.lit(500)).alias("seller_name"), F.col("_images").alias("images"), F.map_from_entries(entries).alias("attributes"), F.col("d.published_at").try_cast("timestamp_ntz").alias("published_at")]
    return joined.select(*(new.get(c, F.col(c)).alias(c) for c in summaries.columns), *extra)


def facebook_page(text: Column) -> Column:
    """A visible page text to a detail document: the first price line, the first line with a state, seven lines after
    the description's heading, the line after the seller's, and key lines with the line that follows them."""
    return F.transform(F.array(lines_of(text)), lambda ls: _facebook_fields(ls))[0]


#: Headings and keys on the pages.
DESCRIPTION_HEADS = ["Descrição do vendedor", "Seller's description", "Descrição", "Description"]
SELLER_HEADS = ["Informações do vendedor", "Seller information", "Seller details"]
KEYS = ["Condição", "Condition", "Marca", "Brand", "Modelo", "Model", "Cor", "Color"]


def _facebook_fields(ls: Column) -> Column:
    at = lambda heads: F.coalesce(*(F.nullif(F.array_position(ls, h), F.lit(0)) for h in heads), F.lit(0)).cast("int")
    body = F.when(at(DESCRIPTION_HEADS) > 0, F.array_join(F.slice(ls, at(DESCRIPTION_HEADS) + 1, 7), "\n"))
    seller = F.when(at(SELLER_HEADS) > 0, F.get(ls, at(SELLER_HEADS)))
    pairs = F.filter(F.array(*(F.struct(F.lit(k).alias("key"), F.when(F.array_position(ls, k) > 0, F.get(ls, F.array_position(ls, k).cast("int"))).alias("value")) for k in KEYS)), lambda p: p["value"].isNotNull())
    price = first_where(ls, lambda x: x.rlike(r"(?i)R\$\s*[\d.]+"))
    place = first_where(ls, lambda x: x.rlike(r",\s*[A-Z]{2}(?![A-Za-z0-9_])"))
    return F.struct(price.alias("price_text"), place.alias("location"), body.alias("description"), seller.alias("seller_name"), F.map_from_entries(pairs).alias("attributes"))


def json_ld_product(html: Column) -> Column:
    """The first JSON-LD object of a page whose type is a product or vehicle, as VARIANT; arrays and @graph count."""
    scripts = F.regexp_extract_all(html, F.lit(r'(?is)<script[^>]*type=["\']application/ld\+json["\'][^>]*>(.*?)</script>'), F.lit(1))
    parsed = F.filter(F.transform(scripts, lambda s: F.try_parse_json(F.trim(s))), lambda v: v.isNotNull())

    def flat(v: Column) -> Column:
        listed = F.try_variant_get(v, "$", "array<variant>")
        graph = F.try_variant_get(v, "$['@graph']", "array<variant>")
        return F.coalesce(listed, graph, F.array(v))

    types = lambda v: F.coalesce(F.try_variant_get(v, "$['@type']", "array<string>"), F.array(F.try_variant_get(v, "$['@type']", "string")))
    wanted = F.filter(F.flatten(F.transform(parsed, flat)), lambda v: F.arrays_overlap(types(v), F.array(F.lit("Product"), F.lit("Vehicle"), F.lit("Car"))))
    return F.get(wanted, F.lit(0))


def listed_attributes(lines: Column) -> Column:
    """`key: value` lines to a map; a later key wins over an earlier one."""
    pairs = F.filter(F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)).alias("key"), F.trim(F.regexp_replace(x, "^[^:]*:?", "")).alias("value"))), lambda p: (p["key"] != "") & (p["value"] != ""))
    return last_wins(pairs)


def last_wins(pairs: Column) -> Column:
    """A map of (key, value) structs; of equal keys the last entry stays."""
    later = lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"])
    return F.map_from_entries(F.filter(pairs, later))


def api_items(df: DataFrame) -> DataFrame:
    """API search items (id, title, price, currency_id, permalink, thumbnail, address) to summaries."""
    return df.select(*_summary("mercadolivre", F.col("id"), F.col("title"), F.col("price"), F.col("currency_id"), joined_place(F.col("address.city_name"), F.col("address.state_name")), F.col("permalink"), F.col("thumbnail")))


def joined_place(city: Column, state: Column) -> Column:
    return F.nullif(F.concat_ws(", ", F.nullif(city, F.lit("")), F.nullif(state, F.lit(""))), F.lit(""))


def api_details(items: DataFrame, descriptions: DataFrame) -> DataFrame:
    """API items with pictures and attributes, left-joined to descriptions (id, plain_text, text)."""
    d = descriptions.select("id", F.coalesce("plain_text", "text").alias("_description"))
    images = F.slice(F.filter(F.transform("pictures", lambda p: F.coalesce(p["secure_url"], p["url"])), lambda u: u.rlike("(?i)^https?://")), 1, 50)
    pairs = F.transform(F.slice("attributes", 1, 200), lambda a: F.struct(a["name"].alias("key"), F.coalesce(a["value_name"], a["value_id"]).alias("value")))
    rows = items.join(d, "id", "left").withColumns({"_images": images, "_attributes": last_wins(pairs)})
    summary = _summary("mercadolivre", F.col("id"), F.col("title"), F.col("price"), F.col("currency_id"), joined_place(F.col("seller_address.city.name"), F.col("seller_address.state.name")), F.col("permalink"), F.coalesce("thumbnail", F.get("_images", F.lit(0))))
    return rows.select(*summary, F.left("_description", F.lit(100_000)).alias("description"), F.lit(None).cast("string").alias("seller_name"), F.col("_images").alias("images"), F.col("_attributes").alias("attributes"), F.col("date_created").try_cast("timestamp_ntz").alias("published_at"))
